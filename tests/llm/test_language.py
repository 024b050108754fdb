from pyspark.sql import functions as F

from tidewatch.llm import language
from tidewatch.llm.common import crc_fold


def test_held_out_accuracy_and_columns(spark, table):
    docs = table("documents")
    held = F.coalesce(crc_fold("doc_id", 4) == 2, F.lit(True))
    found = language.identify(docs.withColumn("score", F.lit("x")), language.fit(docs, ~held), keep=("lang",))
    rows = found.withColumn("held", held).collect()
    own = [r for r in rows if r.held]
    assert len(rows) == docs.count() and len(own) > 20
    assert sum(r.lang == r.lang_pred for r in own) >= 0.95 * len(own)
    assert all(0 <= r.score <= 1 for r in rows)


def test_centroids_match_brute_force():
    texts = ["the cat of the house", "der hund und das haus", "le chat de la maison"]
    tf, letters = language.counts([*texts, None, "", "12 3"])
    assert letters.tolist() == [True] * 3 + [False] * 3
    for i, t in enumerate(texts):
        alone, _ = language.counts([t])
        assert (alone[0] == tf[i]).all()
    # one n-gram of each order per place: letters and one blank after each word
    assert tf[0].sum() == sum(len("the cat of the house ") - k + 1 for k in language.ORDERS)
    assert not tf[3:].any()


def test_odd_rows(odd):
    model = language.fit(odd)
    rows = language.identify(odd, model).collect()
    assert len(rows) == odd.count()
    for r, text in zip(rows, odd.select("text").collect(), strict=True):
        blank = not any(c.isalpha() for c in text[0] or "")
        assert (r.lang_pred == "und") == blank
        assert not blank or (r.score == 0 and r.rejected)
    kept = language.accepted(odd, model)
    assert kept.columns == odd.columns
    assert kept.where("text IS NULL OR trim(text) = ''").count() == 0


def test_no_labels_and_empty(odd):
    assert {r.lang_pred for r in language.identify(odd, language.fit(odd.where("lang IS NULL"))).collect()} == {"und"}
    assert language.identify(odd.limit(0), language.fit(odd)).count() == 0


def test_foreign_script_is_rejected(table):
    model = language.fit(table("documents"))
    lang, score, rejected = language.predict(["привет как дела сегодня", "その他 日本語 文字"], model)
    assert rejected.all()


# Prose in Latin letters of languages that the corpus has not, and junk.
FOREIGN = [
    "wczoraj wieczorem poszliśmy do kina żeby zobaczyć nowy film który wszyscy chwalili ale okazało się że nie był zbyt ciekawy i wróciliśmy do domu",
    "eilen illalla menimme elokuviin katsomaan uutta elokuvaa jota kaikki kehuivat mutta se ei ollut kovin kiinnostava ja palasimme aikaisin kotiin",
    "dün akşam herkesin övdüğü yeni filmi izlemek için sinemaya gittik ama pek ilginç değildi ve eve erken döndük yarın sabah denize gideceğiz",
    "jana jioni tulienda kwenye sinema kutazama filamu mpya ambayo kila mtu aliisifu lakini haikuwa ya kuvutia sana na tulirudi nyumbani mapema",
    "asdkjh qwpoei zxmcnb lkjasd qpwoeir zmxncb alskdj fhgqwe rtyuio plkjhg fdsazx cvbnmq wertyu iopasd",
    "aGVsbG8gd29ybGQgdGhpcyBpcyBhIHRlc3Qgb2YgYmFzZTY0IGVuY29kaW5nIHdpdGggc29tZSBsZW5ndGg",
]


def test_foreign_and_junk_in_latin_letters_is_rejected_and_clean_texts_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    held = F.coalesce(crc_fold("doc_id", 4) == 2, F.lit(True))
    model = language.fit(docs, ~held)
    for times in (1, 5, 20):
        assert language.predict([" ".join([t] * times) for t in FOREIGN], model)[2].all(), times
    assert language.predict(["il gatto mangia il pesce sulla tavola mentre il cane dorme vicino alla porta della cucina e nessuno parla " * 5], model)[2].all()
    texts = [r.text for r in docs.where(held).where("length(text) > 0").orderBy("doc_id").limit(400).collect()]
    rates = {n: language.predict([t[:n] for t in texts if len(t) >= n], model)[2].mean() for n in (20, 40, 80, 160, 400)}
    rates["whole"] = language.predict(texts, model)[2].mean()
    print(rates)
    assert max(rates.values()) <= 0.05
