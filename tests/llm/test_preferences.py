import pytest
from pyspark.sql import functions as F

from baitline.llm import preferences as P

SCHEMA = "conv_id long, turn long, role string, text string, conv string, turns int"
ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "and"), (1, 3, "assistant", "no"), (1, 4, "user", "bye"),
    (2, 1, "assistant", "a"), (2, 0, "user", "hi"), (2, 0, "user", "hi"),
    (3, 0, "user", "alone"), (4, 0, None, None), (4, None, "assistant", "late"), (None, 0, "user", "hi"), (5, 0, "user", "hi"), (5, 0, "assistant", "tie"),
    (6, 0, "user", "x" * 300_000), (6, 1, "assistant", "y" * 300_000),
]


def turns(c):
    some = {(t is None, t or 0, r or "", x or "") for i, t, r, x in ROWS if i == c}
    return [(r, x) for _, _, r, x in sorted(some)]


def render(ts):
    return "".join(f"<|{r}|>\n{x}<|end|>\n" for r, x in ts)


def formatted(chosen, rejected):
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1
    return n, render(chosen[:n]), render(chosen[n:]), render(rejected[n:])


def frame(spark):
    return spark.createDataFrame([(*r, "c", 1) for r in ROWS], SCHEMA)


def test_pairs(spark):
    convs = P.conversations(frame(spark))
    got = {(r.kind, r.chosen_id, r.rejected_id): r for r in P.format_pairs(P.reply_pairs(convs).unionByName(P.opening_pairs(convs))).collect()}
    want = {("opening", 1, 2): (turns(1), turns(2))}
    for c in range(1, 7):
        ts = turns(c)
        at = [i for i, (r, _) in enumerate(ts) if r == "assistant"]
        if at:
            want["reply", c, c] = ts[: at[-1] + 1], ts[: at[-1]] + ([ts[at[-2]]] if len(at) > 1 else [])
    assert got.keys() == want.keys()
    for key, (chosen, rejected) in want.items():
        r = got[key]
        assert (r.n_common, r.prompt, r.chosen, r.rejected) == formatted(chosen, rejected)
        for text, mask in ((r.chosen, r.chosen_mask), (r.rejected, r.rejected_mask)):
            assert sum(m.n for m in mask) == len(text)
            at, trained = 0, []
            for m in mask:
                trained += [text[at : at + m.n]] * m.train
                at += m.n
            said = [x for who, x in (chosen if text is r.chosen else rejected)[r.n_common :] if who == "assistant"]
            assert trained == [f"{x}<|end|>\n" for x in said]


@pytest.mark.parametrize("a,b,n", [("ab", "ab", 2), ("ab", "a", 1), ("", "a", 0), ("", "", 0), ("xa", "ya", 0), ("abc", "abd", 2)])
def test_common_turns(spark, a, b, n):
    turn = "array<struct<role:string,text:string>>"
    df = spark.createDataFrame([([("u", x) for x in a], [("u", x) for x in b])], f"chosen {turn}, rejected {turn}")
    r = P.format_pairs(df).first()
    assert r.n_common == n and r.prompt == render([("u", x) for x in a[:n]])


def test_native_and_empty(spark):
    none = P.conversations(frame(spark).where("false"))
    done = P.format_pairs(P.reply_pairs(none).unionByName(P.opening_pairs(none)))
    assert done.collect() == []
    plan = done._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_common_opening(spark):
    df = spark.range(2000).selectExpr("id AS conv_id", "0L AS turn", "'user' AS role", "IF(id % 3 < 2, 'hello', string(id)) AS text")
    pairs = P.opening_pairs(P.conversations(df))
    assert pairs.count() == 1333 and pairs.select("chosen_id").distinct().collect()[0][0] == 0
