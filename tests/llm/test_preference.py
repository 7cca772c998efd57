import random

from pyspark.sql import functions as F

from chatloom.llm import preference

PAIRS = "id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>, prompt int"


def brute(chosen, rejected):
    clean = lambda side: [((t[0] or ""), (t[1] or "")) for t in side or []]
    a, b = clean(chosen), clean(rejected)
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    n = max(0, min(n, len(a) - 1, len(b) - 1))
    full = lambda turns: "".join(f"<|start|>{r}<|message|>{t}<|end|>\n" for r, t in turns)
    trained = lambda turns: [t + "<|end|>\n" for r, t in turns if r == "assistant"]
    return n, full(a[:n]), full(a[n:]), full(b[n:]), trained(a[n:]), trained(b[n:])


def test_pairs_against_a_loop(spark):
    draw = random.Random(6)
    rows = []
    for i in range(200):
        turns = [(draw.choice(["user", "assistant", None]), draw.choice(["a", "b", "", None])) for _ in range(draw.randint(0, 5))]
        other = list(turns)
        for _ in range(draw.randint(0, 2)):
            other.insert(draw.randint(0, len(other)), (draw.choice(["user", "assistant"]), draw.choice("abc")))
        if draw.random() < 0.3:
            other = other[: draw.randint(0, len(other))]
        rows.append((i, turns if draw.random() < 0.95 else None, other, 1))
    got = preference.format_preferences(spark.createDataFrame(rows, PAIRS), "id").collect()
    assert len(got) == 200
    for r in got:
        _, chosen, rejected, _ = rows[r["id"]]
        n, prompt, a, b, trained_a, trained_b = brute(chosen, rejected)
        assert (r["n_prompt_turns"], r["prompt"]) == (n, prompt)
        assert ("".join(s["text"] for s in r["chosen"]), "".join(s["text"] for s in r["rejected"])) == (a, b)
        assert [s["text"] for s in r["chosen"] if s["trained"]] == trained_a
        assert [s["text"] for s in r["rejected"] if s["trained"]] == trained_b


def test_conversations_from_turns(spark):
    rows = [
        (1, 2, "assistant", "one two three four", 5),
        (1, 1, "user", "hi", 5),
        (2, 1, "user", "no answer", 5),
        (3, None, None, None, 5),
        (3, None, None, None, 5),
        (4, 1, "assistant", "word", 5),
        (None, 1, "user", "nobody's", 5),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, t int")
    chats = preference.assemble(turns)
    pairs = chats.select("conv_id", F.col("turns").alias("chosen"), preference.shortened(F.col("turns")).alias("rejected"))
    got = {r["conv_id"]: r for r in preference.format_preferences(pairs, "conv_id").collect()}
    assert sorted(got) == [1, 2, 3, 4]
    assert got[1]["prompt"] == "<|start|>user<|message|>hi<|end|>\n" and not got[1]["identical"]
    assert [s["text"] for s in got[1]["rejected"] if s["trained"]] == ["one two<|end|>\n"]
    assert got[2]["identical"] and got[2]["n_prompt_turns"] == 0 and got[4]["identical"]
    assert len(got[3]["chosen"]) == 2 and got[3]["n_prompt_turns"] == 1
    empty = preference.assemble(turns.limit(0))
    assert empty.count() == 0
