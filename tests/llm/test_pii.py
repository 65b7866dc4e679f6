import re
from pathlib import Path

import numpy as np

from loamwork.llm import pii, pii_training
from loamwork.llm import pii_model as M

SENTENCES = Path(__file__).with_name("pii_sentences.txt")


def kinds(text):
    return {M.KINDS[k - 1] for _, _, k in pii.find([text])[0]}


def hand_made():
    """(text, spans) of the sentences written by hand, apart from what the model was trained on."""
    out = []
    for line in SENTENCES.read_text().splitlines():
        text, spans, at = "", [], 0
        for m in re.finditer(r"\{(email|phone|id_number|address|person):([^}]*)\}", line):
            text += line[at : m.start()]
            spans.append((len(text), len(text) + len(m[2]), M.KINDS.index(m[1]) + 1))
            text += m[2]
            at = m.end()
        out.append((text + line[at:], spans))
    return out


def hand_made_score():
    """Precision and recall by kind; a span counts as found where one of its kind covers more than half of it."""
    cases = hand_made()
    hit, said, true = np.zeros(6), np.zeros(6), np.zeros(6)
    right = np.zeros(6)
    meets = lambda x, y: x[2] == y[2] and min(x[1], y[1]) - max(x[0], y[0]) > (max(x[1] - x[0], y[1] - y[0])) / 2
    for (_, spans), got in zip(cases, pii.find([t for t, _ in cases]), strict=True):
        for s in spans:
            true[s[2]] += 1
            hit[s[2]] += any(meets(s, g) for g in got)
        for g in got:
            said[g[2]] += 1
            right[g[2]] += any(meets(s, g) for s in spans)
    return {k: (right[i] / max(1, said[i]), hit[i] / true[i]) for i, k in enumerate(M.KINDS, 1)}


def test_hand_made_sentences():
    assert len(hand_made()) > 200
    for kind, (p, r) in hand_made_score().items():
        assert p >= 0.9 and r >= 0.85, (kind, p, r)


def test_held_out_spans():
    for kind, (p, r) in pii_training.score(M.load(), pii_training.samples(1_000, 4_321)).items():
        assert p > 0.75 and r > 0.88, kind


def test_cases_and_look_alikes():
    assert kinds("call +1 (617) 555-0124 if the run stalls") == {"phone"}
    assert kinds("reach me via tomas.berg AT example DOT org, not the channel") == {"email"}
    assert kinds("the sample file has social security no. 927-00-4447 in it") == {"id_number"}
    assert kinds("the badge goes to 145 Millford Court, Oakton PX1 1ZZ") == {"address"}
    assert "person" in kinds("Signed-off-by: Anna Lindqvist <anna@postbox.test>")
    for clean in ("clone git@git.kestrel.example:reader/backlog.git first", "install @saffron/outline@9.0.09", "job 7644646331 finished in 9816 ms", "ticket INC-87321689 is closed", "trace id 6916-4565-3936 was dropped", "please prune adapter and bucket"):
        assert kinds(clean) == set(), clean


def test_neighbours_of_one_kind_stay_apart():
    text = "Anna Lindqvist\nPeter Walker\nRuth Hughes"
    got = pii.find([f"Name: {text}"])[0]
    assert len(got) == 3 and {k for _, _, k in got} == {5}


def test_long_texts_edges_and_placeholders(spark):
    filler = "please prune adapter and bucket. " * 3_000
    rows = [(1, filler + "my number: 202-555-0118 " + filler), (2, None), (3, ""), (4, "thanks, Laura Hughes"), (5, " \n"), (6, "no case here")]
    df = spark.createDataFrame(rows, "id bigint, t string").selectExpr("id", "t", "'x' as text", "'y' as kinds")
    got = {r["id"]: r["text"] for r in pii.redacted_texts(df, "id", "t").collect()}
    assert got[1] == filler + "my number: [PHONE] " + filler and got[2] is None and got[3] == "" and got[4] == "thanks, [PERSON]" and got[6] == "no case here"
    assert {r["id"]: r["kinds"] for r in pii.personal_kinds(df, "id", "t").collect()} == {1: ["phone"], 4: ["person"]}
    assert pii.personal_kinds(df.limit(0), "id", "t").count() == 0


def test_windows_cover_and_reconcile():
    text = "x" * 1_000
    parts = pii.windows(text)
    assert parts[0][0] == 0 and parts[-1][0] + len(parts[-1][1]) == 1_000
    tags = pii.join_windows(1_000, [(a, np.full(len(w), i % 2, np.int8)) for i, (a, w) in enumerate(parts)])
    assert len(tags) == 1_000 and tags[0] == 0


def test_kept_windows_give_the_same(monkeypatch):
    texts = ["call 212-555-0187 now", "thanks, Laura Hughes", "call 212-555-0187 now", "", None, "nothing at all"]
    alone, kept = pii.find(texts), {}
    assert pii.find(texts, kept=kept) == pii.find(texts, kept=kept) == alone
    monkeypatch.setattr(pii, "KEPT", 1)
    assert pii.find(texts, kept=kept) == alone


def test_viterbi_is_the_best_path():
    import itertools

    rng = np.random.default_rng(1)
    for _ in range(3):
        trans = M.transitions({"trans": rng.normal(size=(M.N_TAGS, M.N_TAGS)).astype(np.float32) * 1.5})
        e, n = (rng.normal(size=(3, M.N_TAGS, 3)) * 2).astype(np.float32), np.array([3, 2, 1])
        y = M.viterbi(e, n, trans)
        for j in range(3):
            value = lambda s, j=j: M._first(e)[s[0], j] + sum(e[t, s[t], j] + trans[s[t - 1], s[t]] for t in range(1, n[j]))
            assert tuple(y[: n[j], j]) == max(itertools.product(range(M.N_TAGS), repeat=int(n[j])), key=value)


def test_gradients_are_those_of_the_loss():
    p = {k: v.astype(np.float64) for k, v in M.new_params(3).items()}
    s = sorted(pii_training.samples(5, 8), key=lambda a: -len(a[0][:30]))
    n = np.array([len(t[:30]) for t, _ in s])
    x, y = np.zeros((n[0], len(s)), np.int16), np.zeros((n[0], len(s)), np.int8)
    for j, (t, z) in enumerate(s):
        x[: n[j], j], y[: n[j], j] = M.encode(t[:30]), z[:30]
    _, g = M.loss_and_grad(p, x, n, y)
    for k in p:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        hi, lo = ({a: b.copy() for a, b in p.items()} for _ in range(2))
        hi[k][at] += 1e-2
        lo[k][at] -= 1e-2
        slope = (M.loss_and_grad(hi, x, n, y)[0] - M.loss_and_grad(lo, x, n, y)[0]) / 2e-2
        assert abs(slope - g[k][at]) < 2e-3 + 0.02 * abs(slope)


def test_training_learns_with_one_and_with_two_processes():
    for workers in (1, 2):
        losses = []
        M.fit(pii_training.samples(300, 2), hidden=8, epochs=5, batch=8, rate=1e-2, workers=workers, log=lambda s, losses=losses: losses.append(float(s.split()[-1])))
        assert losses[-1] < 0.7 * losses[0]
