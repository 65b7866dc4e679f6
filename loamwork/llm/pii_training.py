"""Labelled spans to train the personal-data model on: invented texts with many forms of each kind, and look-alikes that are no case.

Filler words come from a public tokenizer's vocabulary (its path is a parameter), so what surrounds a case can be any English words; names, streets
and domains are mostly made of syllables. Run ``python -m loamwork.llm.pii_training`` to train the model anew and store its weights.
"""

from __future__ import annotations

import base64
import functools
import random
import re

import numpy as np

from loamwork.llm import pii_model as M

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
GIVEN = (
    "James Mary John Linda Robert Susan Michael Karen William Sarah Thomas Emily Daniel Emma Matthew Laura George Alice Henry Charlotte Oliver Sophie Jack Lucy Harry Megan Samuel Rachel Peter Ruth Aisha Fatima Omar Khalid Layla Hassan Yasmin Ibrahim "
    "Ahmed Mehmet Ayşe Emre Zeynep Deniz Raj Anil Sunita Deepa Vikram Ananya Arjun Kavya Sanjay Lakshmi Chen Wei Li Ming Xiu Hiroshi Yuki Haruto Aiko Sakura Minjun Jisoo Kwame Ama Chidi Ngozi Thabo Lerato Wanjiru Otieno Oluwaseun "
    "Jean Pierre Camille Léa Antoine Élise François Hélène Hans Klaus Ursula Heike Jürgen Sabine Wolfgang Anke Carlos José Ana Luis Carmen Javier Pilar Rocío Ramón Inés João Beatriz Tiago Catarina Giulia Marco Luca Francesca Giovanni Alessia "
    "Lars Astrid Erik Freja Mikkel Signe Åke Bjørn Kari Øystein Pekka Aino Jan Katarzyna Piotr Agnieszka Tomáš Jana Ivan Olena Dmitri Svetlana Nikolai Irina Dimitris Eleni Ștefan Ioana László Zsófia Femke Joost Sanne Daan Eoin Niamh Siobhán Rhys"
).split()
GIVEN_CYR = "Алексей Наталья Сергей Ольга Михаил Татьяна Андрей Екатерина Павел Людмила Виктор Галина Артём Ксения Роман Полина Денис Вероника Максим Алина".split()
FAMILY = (
    "Smith Jones Taylor Brown Williams Wilson Johnson Davies Patel Wright Walker White Edwards Hughes Green Hall Wood Harris Martin Jackson Clarke Baker Carter Cook Turner Parker King Young Mitchell Murphy O'Connor O'Neill McDonald MacLeod Fitzgerald "
    "Nguyen Tran Kim Park Lee Wang Zhang Liu Tanaka Suzuki Yamamoto Singh Kumar Sharma Gupta Reddy Iyer Banerjee Khan Hussein Haddad Okafor Adeyemi Mensah Nkosi Mwangi García Fernández López Martínez Muñoz Silva Santos Oliveira Pereira "
    "Rossi Bianchi Ferrari Müller Schmidt Schneider Weber Becker Hoffmann Dubois Lefèvre Moreau Girard Jansen Visser Andersson Nilsson Hansen Olsen Virtanen Nowak Kowalska Novák Horváth Popescu Papadopoulos Ivanova Petrov Shevchenko Yılmaz Demir"
).split()
TITLES = "Mr Mrs Ms Miss Dr Prof Mr. Mrs. Ms. Dr. Prof. Sir Madam Herr Frau Señor Señora Sr. Sra. Monsieur Madame Judge Captain Sgt. Rev.".split()
PARTICLES = ["van", "van der", "von", "de", "de la", "del", "di", "da", "dos", "bin", "al", "le", "ter", "ten"]
STREET_TYPES = "Street Road Lane Avenue Court Close Drive Square Way Terrace Crescent Boulevard Place Grove Gardens Mews Hill Row Walk Parkway Circle Trail St St. Rd Rd. Ave Ave. Ln Dr. Blvd Blvd. Ct Pl. Hwy".split()
GERMANIC = "straße strasse str. weg gasse allee platz ring damm ufer straat laan gracht plein gatan vägen gade vej veien katu".split()
ROMANCE = ["rue", "avenue", "boulevard", "place", "rue de la", "rue du", "chemin de", "Rue", "Avenue", "Calle", "Avenida", "Plaza", "Paseo de", "Rua", "Travessa", "Avenida da", "Via", "Viale", "Piazza", "Corso", "ul.", "ulica", "al.", "улица", "ул.", "пр.", "проспект", "переулок"]
TLDS = "com org net io co dev edu gov info biz app eu uk co.uk de fr es it pt nl se no pl ru com.au co.in com.br example test invalid local".split()
ID_WORDS = (
    "SSN|social security number|social security no.|social security|social security #|soc. sec. no.|social insurance number|SIN|passport|passport number|passport no.|passport no|passport nr|passport #|passport id|travel document no.|tax number|tax no.|tax id|tax ID number|TIN|"
    "taxpayer number|taxpayer id|tax file number|TFN|tax reference|UTR|national insurance number|national insurance|national insurance no.|NI number|NI no.|NINO|national id|national ID number|national identity number|identity number|identity no.|identity card|identity card no.|ID card|ID card number|id card no.|"
    "ID number|personal id|personal identity number|personal ID|identification number|citizen number|citizen id|personnummer|personal number|CPF|CPF nº|cpf n.º|RG|DNI|DNI nº|NIE|NIF|codice fiscale|PESEL|BSN|Aadhaar|Aadhaar number|PAN|PAN card|NRIC|CURP|RUT|Steuernummer|Steuer-ID|Reisepass Nr.|Personalausweis|Ausweisnummer|numéro de sécurité sociale|pasaporte|ИНН|СНИЛС|паспорт"
).split("|")
OTHER_NUMBERS = (
    "job|job id|ticket|issue|trace|trace id|span id|build|run|order|order no.|invoice|invoice number|shipment|tracking number|parcel|batch|serial|serial no.|part number|SKU|ISBN|version|release|revision|commit|session|session id|request|request id|transaction|process|pid|port|row|page|record|checksum|epoch|timestamp|offset|"
    "licence key|device|model no.|case|case number|reference|booking ref|flight|train|gate|room|meter|barcode|asset tag|account balance|seed|hash|block|frame|lot|cluster|node|shard|index|key|token count|message|event|incident|deployment|pipeline|worker|thread|line|chunk|object|bucket|snapshot|counter|code"
).split("|")
TOOL_KINDS = "tool app plugin service library framework package module skill theme dashboard editor browser bot server agent script engine project release build command".split()
_O = 0


@functools.cache
def vocabulary(path: str = TOKENIZER) -> tuple[list[str], list[str], list[str]]:
    """Lower-case words, the same of five letters or more, and capitalised words of the tokenizer's vocabulary, the frequent ones first."""
    with open(path, "rb") as f:
        tokens = [base64.b64decode(line.split()[0]) for line in f]
    words = [t[1:].decode() for t in tokens if re.fullmatch(rb" [a-z]{2,12}", t)][:16_000]
    caps = [t[1:].decode() for t in tokens if re.fullmatch(rb" [A-Z][a-z]{2,11}", t)]
    known = {w.lower() for w in [*GIVEN, *FAMILY]}
    lower = set(words)
    caps = [w for w in caps if len(w) > 3 and w.lower() not in known and w.lower() in lower][:4_000]
    return words, [w for w in words if len(w) > 4], caps


class Maker:
    def __init__(self, seed: int, path: str = TOKENIZER):
        self.r = random.Random(seed)
        self.words, self.long, self.caps = vocabulary(path)

    def pick(self, xs):
        return self.r.choice(xs)

    def chance(self, p: float) -> bool:
        return self.r.random() < p

    def digits(self, n: int) -> str:
        return "".join(self.pick("0123456789") for _ in range(n))

    def letters(self, n: int) -> str:
        return "".join(self.pick("ABCDEFGHJKLMNPQRSTUVWXYZ") for _ in range(n))

    def word(self) -> str:
        """Any word, frequent ones more often."""
        return self.words[int(len(self.words) * self.r.random() ** 2.2)]

    def soup(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def made(self) -> str:
        """A capitalised made-up word of one to three syllables."""
        part = lambda: self.pick(["b", "br", "c", "ch", "d", "dr", "f", "fl", "g", "gr", "h", "j", "k", "kl", "l", "m", "n", "p", "pr", "qu", "r", "s", "sch", "sh", "sl", "st", "t", "th", "tr", "v", "w", "y", "z", "", ""]) + self.pick("aaeeiioouy") + self.pick(["", "", "n", "l", "r", "s", "m", "ck", "nd", "rt", "lm", "st", "x", "ng", "ss", "ll", "tt", "rr", "mb", "sk"])
        s = "".join(part() for _ in range(self.r.choice([1, 2, 2, 2, 3])))
        s += self.pick(["", "", "", "son", "sen", "ez", "ov", "ova", "ski", "ska", "man", "ini", "elli", "ton", "er", "ic", "vić", "ian", "escu", "dottir", "eau", "ard", "quist", "lund", "bach", "feld", "mann", "worth", "ham", "ley", "by", "ström", "oğlu", "yan", "enko", "ides"])
        if self.chance(0.06):
            s = s.replace(self.pick("aeou"), self.pick("áéöüñçãø"), 1)
        return s[:1].upper() + s[1:] if len(s) > 2 else self.made()

    def cyr(self) -> str:
        return self.pick("Бар Вол Гур Дав Жел Зим Кар Лос Мар Нем Орл Пав Руд Сав Тум Усп Фил Хар Чер Шам Яр Бел Кра Сте".split()) + self.pick(["", "а", "о", "ен", "ин", "ал", "ит", "ур"]) + self.pick("ов ова ин ина ский ская енко ев ева ук ян ых дзе швили ко рек лин мов тов ган бах".split())

    def given(self) -> str:
        return self.pick(GIVEN) if self.chance(0.78) else self.made()[:9]

    def family(self, given: str = "") -> str:
        """A family name; a common word only beside a known given name."""
        x = self.r.random()
        return self.pick(FAMILY) if x < 0.3 else self.pick(self.caps) if x > 0.86 and given in GIVEN else self.made()

    # --- values by kind

    def person(self, cue: bool = False) -> str:
        x, g = self.r.random(), self.given()
        f = self.family(g)
        initial = lambda: self.pick("ABCDEFGHIJKLMNOPRSTVWYZ") + "."
        if x < 0.34:
            s = f"{g} {f}"
        elif x < 0.41:
            s = f"{g} {initial()} {f}"
        elif x < 0.47:
            s = f"{initial()} {f}" if self.chance(0.8) else f"{initial()} {initial()} {f}"
        elif x < 0.56:
            s = f"{self.pick(TITLES)} {f}"
        elif x < 0.62:
            s = f"{self.pick(TITLES)} {self.pick([g, initial()])} {f}"
        elif x < 0.69:
            s = f"{g} {f}-{self.family()}"
        elif x < 0.76:
            s = f"{g} {self.pick(PARTICLES)} {f}"
        elif x < 0.83:
            s = f"{f}, {g}" + (f" {initial()}" if self.chance(0.2) else "")
        elif x < 0.86:
            s = f"{g} {self.given()} {f}"
        elif x < 0.91:
            s = (self.pick(GIVEN_CYR) if self.chance(0.7) else self.cyr()) + " " + self.cyr()
        else:
            g = self.pick(GIVEN)
            s = f"{g} {self.pick(FAMILY) if self.chance(0.6) else self.family(g)}"
        y = self.r.random()
        if y < 0.08:
            s = s.upper()
        elif cue and (x < 0.34 or x >= 0.91) and y < 0.16 and g in GIVEN:
            s = s.lower()
        return s

    def host(self) -> str:
        part = lambda: self.pick([self.pick(self.long), self.made().lower(), self.pick(self.long) + self.pick(["-", ""]) + self.word()])
        s = ".".join([part() for _ in range(self.pick([1, 1, 1, 2]))] + [self.pick(TLDS)])
        return re.sub(r"[^a-z0-9.-]", "", s)

    def user(self) -> str:
        g, f = self.given().lower(), self.family().lower()
        g, f = re.sub("[^a-z]", "", g) or "ab", re.sub("[^a-z]", "", f) or "cd"
        n = self.digits(self.r.randint(1, 4))
        return self.pick([g, f, f"{g}.{f}", f"{g[0]}{f}", f"{g[0]}.{f}", f"{g}_{f}", f"{f}{n}", f"{g}{n}", f"{f}.{g}", f"{g}-{f}", f"{g}.{f}{n}", f"{g}+{self.word()}", f"{g}.{f}-{self.word()}", f"{g}_{f[:3]}", self.pick(["info", "sales", "me", "office", "hello", "admin"]), f"{self.word()}.{self.word()}"])

    def email(self) -> str:
        u, h, x = self.user(), self.host(), self.r.random()
        if x < 0.45:
            return f"{u}@{h}"
        if x < 0.51:
            return f"{u}{self.pick([' @ ', '@ ', ' @'])}{h}"
        if x < 0.57:
            return f"{u}＠{h}"
        if x < 0.62:
            return f"{self.pick(['mailto:', 'MAILTO:', 'mail:', 'email:'])}{u}@{h}"
        if x < 0.67:
            return f"{u}@{h}".upper()
        at, dot = self.pick([("at", "dot"), ("AT", "DOT"), ("(at)", "(dot)"), ("[at]", "[dot]"), ("{at}", "{dot}"), ("<at>", "<dot>"), ("_at_", "_dot_"), ("-at-", "-dot-"), ("[at]", "."), ("(at)", "."), ("AT", "."), ("at", "."), ("(AT)", "(DOT)"), ("[@]", "[.]"), (" [at] ", "."), ("(a)", ".")])
        gap = " " if at.isalpha() or self.chance(0.55) else ""
        dot = f"{gap}{dot}{gap}" if dot != "." else "."
        s = f"{u}{gap}{at}{gap}{h.replace('.', dot)}"
        return s.upper() if self.chance(0.04) else s

    def phone(self) -> str:
        d = self.digits
        x = self.r.random()
        if x < 0.36:  # country code and groups
            sep = self.pick([" ", " ", "-", ".", ""])
            cc = str(self.pick([1, 7, 20, 27, 30, 31, 33, 34, 39, 41, 43, 44, 45, 46, 47, 48, 49, 52, 54, 55, 61, 64, 65, 81, 82, 86, 90, 91, 234, 254, 351, 353, 358, 380, 420, 852, 971]))
            groups, left = [], self.r.randint(8, 11) - len(cc) + 1
            while left > 0:
                n = min(left, self.pick([1, 2, 2, 3, 3, 4, 5, 8]))
                groups.append(d(n))
                left -= n
            if self.chance(0.25):
                groups[0] = f"({groups[0]})"
            s = self.pick(["+", "+", "+", "+", "00", "tel:+", "tel: +"]) + cc + sep + sep.join(groups)
        elif x < 0.68:  # three, three and four
            a, b, c = self.pick("23456789") + d(2), d(3), d(4)
            s = self.pick([f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"1-{a}-{b}-{c}", f"+1 ({a}) {b}-{c}", f"+1{a}{b}{c}", f"+1-{a}-{b}-{c}", f"+1 {a} {b} {c}", f"tel:+1-{a}-{b}-{c}", f"{a}/{b}-{c}", f"({a}){b}-{c}"])
        else:  # national, with a leading zero
            s = self.pick([f"(0{d(2)}) {d(4)} {d(4)}", f"(0{d(3)}) {d(6)}", f"0{d(2)} {d(4)} {d(4)}", f"0{d(3)} {d(3)} {d(4)}", f"0{d(4)} {d(6)}", f"07{d(3)} {d(6)}", f"07{d(9)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(1)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", f"0{d(2)}/{d(7)}", f"0{d(2)}-{d(7)}", f"0{d(3)}-{d(7)}", f"(0{d(1)}) {d(4)} {d(4)}", f"0{d(2)} {d(3)} {d(2)} {d(2)}", f"({d(2)}) 9{d(4)}-{d(4)}", f"8 ({d(3)}) {d(3)}-{d(2)}-{d(2)}"])
        if self.chance(0.1):
            s += self.pick([" ext. ", " ext ", " x", " ext.", ", ext. ", " extension "]) + d(self.r.randint(2, 4))
        if self.chance(0.06):
            s = "".join(chr(ord(c) + 0xFEE0) if c.isdigit() else c for c in s)
        return s

    def street(self) -> str:
        x = self.r.random()
        s = self.made() if x < 0.5 else self.pick(self.caps) if x < 0.75 else self.pick(self.long).capitalize() if x < 0.9 else self.pick(GIVEN + FAMILY)
        return s + " " + self.pick(self.caps) if self.chance(0.12) else s

    def address(self) -> str:
        n, s, d = str(self.r.randint(1, 320)) if self.chance(0.85) else str(self.r.randint(300, 19_999)), self.street(), self.digits
        n += self.pick(["", "", "", "", "", "a", "B", "-" + str(self.r.randint(2, 40)), "/2"]) if self.chance(0.4) else ""
        t = self.pick(STREET_TYPES)
        x = self.r.random()
        if x < 0.4:
            out = f"{n}{self.pick(['', '', '', ','])} {s} {t}"
        elif x < 0.47:
            out = f"{n} {self.pick(['N.', 'S.', 'E.', 'W.', 'North', 'South', 'East', 'West', 'NW', 'SE', 'Old', 'Upper', 'Great', 'St.'])} {s} {t}"
        elif x < 0.53:
            out = f"{self.pick(['No.', 'no.', 'Nr.', 'No', 'Number', '№'])} {n} {s} {t}"
        elif x < 0.59:
            out = f"{self.pick(['Flat', 'Apt', 'Apt.', 'Unit', 'Suite', 'Room', 'Floor', 'Apartment'])} {self.r.randint(1, 60)}{self.pick(['', 'A', 'b'])}, {n} {s} {t}"
        elif x < 0.75:
            kind = self.pick(GERMANIC)
            joint = self.pick(["", "", "", "-", " "])
            kind = kind if joint == "" else kind.capitalize()
            out = f"{s.split()[0]}{joint}{kind} {n}"
        elif x < 0.93:
            way = self.pick(ROMANCE)
            name = self.cyr() + "ая" if way[0] > "а" else s
            out = self.pick([f"{way} {name} {n}", f"{way} {name}, {n}", f"{n}, {way} {name}", f"{n} {way} {name}", f"{way} {name}, {self.pick(['nº', 'n.', 'д.', 'no.'])} {n}"])
        else:
            out = f"{s} {t} {n}"
        y = self.r.random()
        if y < 0.12:
            out += self.pick([" Apt ", " Apt. ", ", Apt ", ", Flat ", " Unit ", ", Suite ", " #", ", "]) + str(self.r.randint(1, 80)) + self.pick(["", "A", "B", "C", "º B", "º A", "ª izq."])
        elif y < 0.2:
            out += f", {self.made()}" + self.pick(["", f" {self.letters(2)}{d(1)} {d(1)}{self.letters(2)}", f", {self.letters(2)} {d(5)}", f" {d(5)}"])
        elif y < 0.24:
            out += self.pick([f", {d(5)} {self.made()}", f", {d(4)} {self.letters(2)} {self.made()}"])
        return out.upper() if self.chance(0.07) else out

    def id_value(self) -> str:
        d, L = self.digits, self.letters
        return self.pick([
            f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", f"{d(9)}", f"{d(3)}.{d(3)}.{d(3)}-{d(2)}", f"{d(11)}", f"{L(1)}{d(7)}", f"{L(1)}{d(8)}", f"{L(2)}{d(7)}", f"{L(2)}{d(6)}", f"{L(2)} {d(7)}", f"{L(2)}{d(6)}{L(1)}", f"{L(2)} {d(2)} {d(2)} {d(2)} {L(1)}",
            f"{L(2)}-{d(2)}-{d(2)}-{d(2)}-{L(1)}", f"{d(8)}{L(1)}", f"{d(8)}-{L(1)}", f"{L(1)}{d(7)}{L(1)}", f"{L(1)}-{d(7)}-{L(1)}", f"{d(4)} {d(4)} {d(4)}", f"{d(4)}-{d(4)}-{d(4)}", f"{d(12)}", f"{d(6)}-{d(4)}", f"{d(8)}-{d(4)}", f"{d(2)} {d(3)} {d(3)}", f"{d(10)}", f"{d(3)} {d(3)} {d(3)}", f"{d(2)}/{d(3)}/{d(5)}", f"{L(5)}{d(4)}{L(1)}",
            f"{d(3)}-{d(3)}-{d(3)} {d(2)}", f"{d(2)} {d(2)} {d(6)}", f"{d(2)}.{d(3)}.{d(3)}-{self.pick('0123456789K')}", f"{L(6)}{d(2)}{L(1)}{d(2)}{L(1)}{d(3)}{L(1)}", f"{d(1)} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)} {d(2)}",
        ])

    # --- texts without a case

    def other_number(self) -> str:
        """What a number is called that identifies no person."""
        k = self.pick(OTHER_NUMBERS) if self.chance(0.6) else self.word()
        return k + (self.pick(["", "", "", "", " id", " id", " ID", " number", " no.", " card", " nr"]) if " " not in k else "")

    def decoy(self) -> str:
        d, w, c = self.digits, self.word, lambda: self.pick(self.caps)
        hexes = lambda n: "".join(self.pick("0123456789abcdef") for _ in range(n))
        x = self.r.random()
        if x < 0.32:  # numbers that aren't said to identify a person
            v = self.id_value() if self.chance(0.5) else self.pick([d(self.r.randint(4, 13)), f"{d(4)}-{d(4)}-{d(4)}", f"{d(4)} {d(4)} {d(4)}", f"{self.letters(3)}-{d(self.r.randint(3, 9))}", f"{d(4)}-{d(3)}-{d(4)}", f"{d(8)}-{d(4)}"])
            k = self.other_number()
            return self.pick([f"{k} {v} {self.soup(1, 3)}", f"{k}: {v}", f"the {k} {v}", f"{k}={v}", f"{self.soup(1, 3)} {k} {v}", f"{k.upper()}-{v}", f"{v} {k}s {w()}", f"{k} #{v}"])
        if x < 0.52:  # capitalised words of tools, titles and places
            a, b = c(), self.pick([self.pick(self.long).capitalize(), c()])
            t = self.pick(TOOL_KINDS)
            return self.pick([f"the {a} {b} {t} {self.soup(1, 3)}", f"the {a} {b} {t}", f"{self.soup(1, 4)} the {a} {b} {t} {self.soup(1, 3)}", f"the {a} {b} {t} {self.soup(2, 4)}", f"the {self.made()} {b} {t} {self.soup(1, 3)}", f"{self.made()} {b} {t}", f"the {self.made()} {t}", f"the {a} {b} {w()} {w()}", f"{a} {b} {t}", f"{self.pick(['open', 'run', 'install', 'use', 'restart', 'update', 'try'])} {a} {b}", f"{self.pick(['step', 'chapter', 'part', 'level', 'section', 'figure', 'phase'])} {self.r.randint(1, 40)} {a} {b} of the {w()} {w()}", f"see {a} {b}", f"{a} {w()} the {w()}", f"{a}: {self.soup(2, 4)}", f"{self.pick(GIVEN)} {self.pick(['said', 'left', 'wrote', 'and I', 'is out'])} {w()}", f"# {a} {b} {c()}", f"in {a} and {b}", f"{a} {b} {d(1)}.{d(1)}", f"the {b} {t} for {a}", f"{self.letters(3)} {a}", f"{a} {w()} {b} {w()}"])
        if x < 0.66:  # signs of an address that belong to programs
            h, t = self.host(), self.pick(self.long)
            return self.pick([f"git@{h}:{t}/{w()}.git", f"git clone git@{h}:{t}/{w()}.git", f"ssh://git@{h}/{t}/{w()}", f"https://{w()}@{h}/{t}/{w()}.git", f"clone git@git.{h}:{t}/{w()}.git first", f"ssh {self.pick(['root', 'deploy', 'ubuntu', 'git', 'admin'])}@{d(2)}.{d(1)}.{d(2)}.{d(1)}", f"ssh deploy@{t}:22", f"@{t}/{w()}@{d(1)}.{d(1)}.{d(2)}", f"npm install @{t}/{w()}", f"install @{t}/{w()}@^{d(1)}.{d(1)}.{d(1)}", f"{t}@{d(1)}.{d(2)}.{d(1)}", f"pin {t}@{d(2)}.{d(1)}.{d(1)}", f"the @{t} decorator", f"@{t}.{w()}({w()}=1)", f"{{user}}@{{host}}", f"<user>@<host>", f"${{{w()}}}@${{{w()}}}", f"{t}@sha256:{hexes(16)}", f"https://{h}/@{t}/{d(6)}", f"@{t} {self.soup(1, 3)}", f"cc @{t}", f"look at {h}", f"meet at the {w()} dot {w()}", f"{w()} @ {d(2)}:{d(2)}", f"user@{self.pick(['localhost', 'host'])}:~$ {w()}", f"actions/{t}@v{d(1)}"])
        if x < 0.79:  # counts and capitalised or street-like words that are no address
            n = str(self.r.randint(1, 400))
            return self.pick([f"{n} {self.soup(1, 3)}", f"step {n} {self.pick(self.caps)} {self.pick(['Map', 'View', 'Change', 'Test', 'Plan', 'Light', 'Art'])}", f"the {n} {w()} road map", f"{n} drive tests {w()}", f"{n} court cases", f"{n} ways to {w()}", f"lane {n} of the {w()}", f"drive {n} is {w()}", f"level {n} Street {self.pick(self.caps)}", f"{n} {self.pick(['st', 'nd', 'rd', 'th'])} {w()}", f"row {n}, {w()} {d(2)}", f"{n} street {self.pick(['views', 'lamps', 'maps'])}", f"page {n}, line {d(2)}", f"{w()} {n} - {w()} {d(3)}", f"{n} x {d(2)} {w()}", f"{n}% of the {w()} drive", f"Chapter {n}, {c()} {c()}", f"{n} {c()}", f"{n} {c()} {w()}s", f"mount the {w()} drive", f"square {n} by {d(2)}"])
        return self.pick([  # times, versions and other numbers
            f"20{d(2)}-0{self.r.randint(1, 9)}-{self.r.randint(10, 28)} {self.r.randint(10, 23)}:{d(1)}0:{d(1)}5", f"at {d(2)}:{d(2)}:{d(2)}", f"20{d(2)}-1{self.pick('012')}-{d(1)}T{d(2)}:{d(2)}:{d(2)}Z", f"{d(1)} {c()} 20{d(2)}", f"{d(3)}.{d(3)}.{d(1)}.{d(2)}:{d(4)}", f"10.{d(1)}.{d(2)}.{d(1)}", f"v{d(1)}.{d(2)}.{d(3)}", f"version {d(2)}.{d(1)}.{d(4)}.{d(2)}", f"1{d(9)}", f"1{d(12)}", f"${d(3)}.{d(2)}", f"€{d(1)}.{d(3)},{d(2)}", f"{d(3)},{d(3)},{d(3)}",
            f"{d(2)}.{d(6)}, -{d(2)}.{d(6)}", f"0x{hexes(8)}", hexes(40), f"{hexes(8)}-{hexes(4)}-{hexes(4)}-{hexes(4)}-{hexes(12)}", f"{hexes(7)}", f"{d(3)} ms and {d(4)} kB", f"{d(2)}/{d(2)}/20{d(2)}", f"error {d(4)}: {self.soup(2, 4)}", f"[{d(5)}] {self.soup(2, 4)}", f"pages {d(3)}-{d(3)}", f"{d(4)}-{d(4)} season", f"ISBN 978-{d(1)}-{d(5)}-{d(3)}-{d(1)}", f"{d(2)}-{d(2)}-{d(2)} {d(2)}:{d(2)}", f"ratio {d(1)}.{d(5)}", f"{d(1)} + {d(2)} = {d(2)}", f"{d(4)} {d(4)} {w()}", f"HTTP {d(3)} {self.soup(1, 2)}", f"port {d(5)}", f"{w()}-{d(3)}-{w()}-{d(2)}", f"{w()}_{d(4)}", f"{self.letters(2)}{d(4)} {w()}",
        ])

    def plain(self) -> str:
        s = self.soup(3, 12)
        x = self.r.random()
        if x < 0.5:
            s = s.capitalize()
        if x < 0.25:
            s = s.replace(" ", ", ", 1)
        if 0.5 < x < 0.6:
            s = f"```\n{s}\n```"
        if 0.6 < x < 0.66:
            s = s.replace(" ", " -> ", 1)
        return s + self.pick(["", ".", ".", "?", "!"])

    # --- texts with cases

    def case(self) -> list[tuple[str, int]]:
        """Pieces (text, kind) of one sentence with personal data."""
        o = lambda s: (s, _O)
        x, frame = self.r.random(), self.chance(0.58)
        if x < 0.17:
            v, frames = (self.email(), 1), ["write to |", "email me at |", "reach us at |", "send it to | please", "| bounced again", "contact | for details", "my new address is |", "login: |", "user=|", "account | is locked", "From: |", "to: |, cc: nobody", "invite | to the call", "| has no access", "subscribe | to the list", "forward this to |", "<|>", "sent by |", "(|)", "mail from | was dropped", "if unsure ask |", "you can find me under |", "notify |", "recipient=|;", "the form was filled in by |", "escribe a |", "écrivez à |", "bitte an | senden"]
        elif x < 0.34:
            v, frames = (self.phone(), 2), ["call |", "phone: |", "call me on | after six", "tel. |", "fax |", "my number is |", "mobile |", "ring | if nobody answers", "text | when you arrive", "| is the number to dial", "reach the desk on |", "contact=|", "phone=|", "Tel: |", "you can reach her at |", "hotline: |", "the callback number was |", "WhatsApp |", "dial | and wait", "left a voicemail from |", "he hung up on |", "T: |", "emergency number |", "missed call from |", "Telefon: |", "teléfono |", "appelez le |", "number on file: |", "printed | on the flyer", "my number: |", "number: |", "his number is |", "the number | rings out", "her cell |", "| was busy all day", "direct line: |", "or try |"]
        elif x < 0.54:
            k = self.pick(ID_WORDS)
            k = k.upper() if self.chance(0.05) else k.lower() if self.chance(0.15) else k[0].upper() + k[1:] if self.chance(0.2) else k
            v = (self.id_value(), 3)
            if self.chance(0.45):  # the same sentences about other numbers: only the words beside it tell
                k = self.other_number()
                v = (self.id_value() if self.chance(0.7) else self.pick([self.digits(10), f"1{self.digits(9)}", f"{self.digits(4)}-{self.digits(4)}-{self.digits(4)}", self.digits(12)]), 0)
            frames = [f"{k} |", f"{k}: |", f"{k} = |", f"{k}=|", f"my {k} is |", f"{k} (|)", f"his {k}, |, was copied", f"the {k} | is on file", f"| is her {k}", f"| was given as {k}", f"please check {k} |", f"{self.soup(1, 4)} {k} | {self.soup(1, 4)}", f"{self.soup(1, 4)} {k} |", f"{self.soup(0, 3)} | {self.pick(['as', 'for', 'next to', 'beside', 'under', 'is the', 'in the field', 'instead of the', '-', '(', 'near'])} {k}", f"{self.soup(1, 4)} | {self.soup(0, 2)} {k}", f"{k} of the applicant: |", f"{k} ends up as | here", f"he entered | where the {k} belongs", f"{k} {self.pick(['is', 'was', 'no', 'reads', '#', '-', '->', 'shows'])} |", f"{k} | expired", f"| is what the {k} says", f"a {k} with the number |", f"{k}, |, is wrong", f"{k} {self.word()} |", f"we need the {k}, e.g. |", f"| ({k})", f'"{k}": "|"', f"{k}\t|", f"rejected {k} | as {self.word()}"]
        elif x < 0.69:
            v, frames = (self.address(), 4), ["lives at |", "I live at |", "deliver to |", "our office is at |", "ship to |", "address: |", "address=|", "Address: |", "meet me at | at noon", "the parcel went to |", "moved to | last year", "the house at | is for sale", "come to | tomorrow", "the meeting is in |", "billing address |", "born at |", "the clinic at |", "pick it up from |", "the van stopped outside |", "site visit: |", "located at |", "the tenant of |", "he was seen near |", "| is the place", "send the letter to |", "residence: |", "venue |", "Adresse: |", "dirección: |", "from | to the station"]
        elif x < 0.86:
            frame = not self.chance(0.42)
            v, frames = (self.person(frame), 5), ["thanks, |", "Dear |,", "Hi |,", "ask | about it", "please ask |", "contact |", "written by |", "signed, |", "regards, |", "| wrote this", "| owns it", "| is on leave", "the report by |", "reviewed by |", "author: |", "owner: |", "name=|", "Name: |", "met with | today", "| will call back", "patient | was admitted", "booked by |", "assigned to |", "according to |", "cc |", "speak to | first", "interview with |", "| and the team", "our manager | agreed", "the claimant, |,", "from |:", "invited | to join", "my colleague | said so", "| joined as an engineer", "hand it to |", "witness: |", "on behalf of |", "for | only", "attn. |", "yours, |", "it was | who found it", "the defendant | left", "prize for |", "| fixed it", "| scored twice", "voicemail from |", "belongs to |", "Lord |", "my neighbour | sang", "I bought it from |", "the owner is |", "a letter came for |", "her name is |"]
        elif x < 0.93:
            p, e = (self.person(), 5), (self.email(), 1)
            a, b, c = self.pick([("", " <", ">"), ("From: ", " <", ">"), ("by ", " (", ")"), ('name: "', '", email: "', '"'), ("", ", ", ""), ("contact ", " at ", ""), ("", " - ", ""), ("Author: ", " <", ">"), ("Co-developed-by: ", " <", ">"), ("| ", " | ", " |"), ('{"name": "', '", "mail": "', '"}'), ("maintainer=", ";", "")])
            return [o(a), p, o(b), e, o(c)]
        else:
            parts = [(self.person(), 5), (self.address(), 4), (self.phone(), 2), (self.email(), 1)]
            self.r.shuffle(parts)
            sep, out = self.pick(["\n", "\n", "\n  ", " / ", ", ", "; ", " | ", "\t"]), [o(self.pick(["", "", f"{self.soup(1, 3)}:", f"{self.soup(1, 3)}", "Contact", "Kind regards", "Bill to:", "| a | b | c |"]))]
            for p in parts[: self.r.choice([2, 2, 3, 3, 4])]:
                out += [o(sep), p]
            return out
        if not frame and v[1] not in (0, 3):  # any words around it
            head, tail = self.soup(0, 4), self.soup(0, 4)
            head = head[:1].upper() + head[1:] if self.chance(0.5) else head
            if v[1] == 5 and self.chance(0.3):  # names side by side
                return [o(head + " " if head else ""), v, o(self.pick([" and ", " and ", ", ", " & ", " or ", " with ", "; ", "\n"])), (self.person(), 5), o(" " + tail if tail else self.pick(["", "."]))]
            a = head + self.pick([" ", " ", " ", ": ", "=", ", ", ' "', " (", "\n", "> ", "/"]) if head else self.pick(["", "", '"', "- ", "(", "> "])
            b = self.pick([" ", " ", " ", ", ", ". ", '" ', ") ", "\n", ": ", "; "]) + tail if tail else self.pick(["", "", ".", '"', ",", ")", "?", ";"])
            return [o(a), v, o(b)]
        a, b = self.pick(frames).split("|", 1)
        if self.chance(0.25):
            a = f"{self.soup(1, 4)} {a}"
        if self.chance(0.4):
            a = a[:1].upper() + a[1:]
        if self.chance(0.2):
            b = f"{b} {self.soup(1, 4)}"
        return [o(a), v, o(b)]

    def dressed(self, pieces: list[tuple[str, int]]) -> list[tuple[str, int]]:
        pre, post = self.pick([("", "")] * 12 + [("> ", ""), ("**", "**"), ("| x | ", " |"), ('msg="', '"'), ("// ", ""), ("# ", ""), (f"{self.r.randint(10, 23)}:{self.r.randint(10, 59)} INFO ", ""), ('{"text": "', '"}'), ("<p>", "</p>"), ("- ", ""), ("`", "`"), ("[", "]"), ("* ", ""), ("<!-- ", " -->"), ("(", ")"), (f"{self.r.randint(1, 9)}. ", ""), ("NOTE: ", ""), ("'", "'"), ("Q: ", "")])
        return [(pre, _O), *pieces, (post, _O)]

    def sample(self) -> tuple[str, np.ndarray]:
        parts: list[tuple[str, int]] = []
        for i in range(self.r.choice([1, 1, 2, 2, 3, 4])):
            if i:
                parts.append((self.pick([" ", " ", ". ", ". ", "; ", "\n", "\n> ", ", ", "? "]), _O))
            x = self.r.random()
            parts += self.dressed(self.case()) if x < 0.52 else self.dressed([(self.decoy(), _O)]) if x < 0.82 else [(self.plain(), _O)]
        if self.chance(0.5):
            parts.append((self.pick([".", ".", "", "?", ";"]), _O))
        text = "".join(t for t, _ in parts)
        tags = [np.full(len(t), 2 * k, np.int8) for t, k in parts]
        for (t, k), y in zip(parts, tags, strict=True):
            if k and t:
                y[0] = 2 * k - 1
        return text, np.concatenate(tags) if text else np.zeros(0, np.int8)


def samples(n: int, seed: int, path: str = TOKENIZER) -> list[tuple[str, np.ndarray]]:
    m = Maker(seed, path)
    out = [m.sample() for _ in range(n)]
    return [(t[:260], y[:260]) for t, y in out if t]


def runs(y: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the spans of a tag sequence."""
    starts = np.flatnonzero(y % 2 == 1)
    out = []
    for a in starts:
        b = a + 1
        while b < len(y) and y[b] == y[a] + 1:
            b += 1
        out.append(((int(y[a]) + 1) // 2, int(a), int(b)))
    return out


def score(p: dict, held: list[tuple[str, np.ndarray]]) -> dict[str, tuple[float, float]]:
    """Precision and recall of exact spans by kind on held-out samples."""
    got = M.decode(p, [M.encode(t) for t, _ in held])
    pairs = [(set(runs(y)), set(runs(g)) if g is not None else set()) for (_, y), g in zip(held, got, strict=True)]
    out = {}
    for k, kind in enumerate(M.KINDS, 1):
        tp = sum(len({s for s in a & b if s[0] == k}) for a, b in pairs)
        out[kind] = (tp / max(1, sum(s[0] == k for _, b in pairs for s in b)), tp / max(1, sum(s[0] == k for a, _ in pairs for s in a)))
    return out


def main(n: int = 90_000, hidden: int = 32, epochs: int = 6, workers: int = 8, rounds: int = 7, path: str = TOKENIZER) -> None:
    """Rounds of fresh samples, each from the weights before; what is stored is the mean of the last two rounds' weights, three to one."""
    p, ends = None, []
    for seed in range(1, rounds + 1):
        p = M.fit(samples(n, seed, path), hidden, epochs, batch=32, rate=8e-3 if seed == 1 else 5e-3, params=p, workers=workers, log=lambda s: print(s, flush=True))
        ends.append({k: v.copy() for k, v in p.items()})
    M.save({k: (ends[-2][k] + 3 * ends[-1][k]) / 4 for k in p} if rounds > 1 else p)
    print(score(M.load(), samples(2_000, 99, path)))


if __name__ == "__main__":
    import sys

    main(*map(int, sys.argv[1:]))
