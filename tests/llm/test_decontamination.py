import random
import re
from collections import Counter

from tidewatch.llm import decontamination as decon


def words(text):
    return [w for w in re.split(r"[^\w]+", (text or "").lower()) if w]


def brute(text, items, threshold=0.8):
    """Best similarity of any window for each item, by trying all windows."""
    out, w = {}, words(text)
    for item, content in items.items():
        own = words(content)
        n, size = len(own), min(5, len(own))
        if not n:
            continue
        bag = Counter(tuple(own[k:k + size]) for k in range(n - size + 1))
        best = 0.0
        for s in range(max(len(w) - n, 0) + 1):
            part = w[s:s + n]
            other = Counter(tuple(part[k:k + size]) for k in range(len(part) - size + 1))
            shared = sum((bag & other).values())
            best = max(best, shared / (sum(bag.values()) + sum(other.values()) - shared) if other else 0.0)
        if best >= threshold:
            out[item] = best
    return out


def test_against_brute_force(spark, table):
    random.seed(5)
    items = {r.item_id: r.text for r in table("benchmark").collect()}
    items |= {900: "one two three", 901: "", 902: None, 903: "go go go go go go go go"}
    benchmark = spark.createDataFrame(list(items.items()), "item_id long, text string")
    docs = []
    for k in range(60):
        w = words(random.choice([t for i, t in items.items() if i < 900]))
        for _ in range(random.randint(0, 4)):
            at = random.randrange(len(w))
            w[at:at + random.randint(0, 1)] = random.choice([[], ["zzq"], ["xxq"]])
        pad = [f"pad{random.randrange(99)}" for _ in range(random.choice([0, 0, 3, 30]))]
        docs.append((k, " ".join(pad + w + pad)))
    docs += [(70, "say One two, three!"), (71, "go " * 20), (72, None), (73, ""), (74, "one two"), (None, docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {(r.doc_id, r.item_id): r.similarity for r in decon.matches(df, benchmark).collect()}
    expected = {(d, i): s for d, t in docs for i, s in brute(t, items).items()}
    assert found.keys() == expected.keys()
    assert all(abs(found[k] - expected[k]) < 1e-9 for k in found)
    bad = {d for d, _ in expected}
    assert sorted(map(str, (r.doc_id for r in decon.decontaminate(df, benchmark).collect()))) == sorted(str(d) for d, _ in docs if d not in bad)
    assert decon.matches(df, benchmark.limit(0)).count() == 0
    assert decon.decontaminate(df, benchmark.limit(0)).count() == len(docs)


def test_odd_rows(odd, spark):
    benchmark = spark.createDataFrame([(1, "the house of the man and the sea", "x"), (None, "der mann und das haus", None), (3, None, None)], "item_id long, text string, __key string")
    clean = decon.decontaminate(odd, benchmark)
    assert clean.columns == odd.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(map(str, [3, 4, 5, None, 6, 7, 8, 9]))
    assert decon.decontaminate(odd.limit(0), benchmark).count() == 0


def test_no_python_in_the_plan(table):
    plan = decon.matches(table("documents"), table("benchmark"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
