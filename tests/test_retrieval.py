"""Search, understanding and answering on small corpora."""

from collections import Counter

import pytest

from lumenfold.operators import answer, search, understand
from lumenfold.operators.index import PassageIndex, alignment
from lumenfold.operators.search import Retriever

VERSES = [
    ("1:1", "In the name of the Gracious, the Merciful.", ""), ("2:153", "Seek help through patience and prayer; He is with the patient.", ""), ("2:255", "Neither slumber nor sleep overtakes Him; His throne extends over the heavens.", ""),
    ("2:286", "No soul is burdened beyond what it can bear.", ""), ("3:134", "Those who forgive people; He loves the doers of good.", ""), ("39:53", "Do not despair of His mercy; He may forgive all sins.", ""),
    ("94:5", "With hardship comes ease.", ""), ("20:9", "And has the story of Musa reached you", ""), ("1:2", "The Praise, Lord of the Worlds", "ٱلْحَمْدُ لِلَّهِ رَبِّ ٱلْعَٰلَمِينَ"), ("1:3", "The Beneficent", "ٱلرَّحْمَٰنِ ٱلرَّحِيمِ"),
]


@pytest.fixture(scope="module")
def passages(spark):
    return spark.createDataFrame([(i, *v) for i, v in enumerate(VERSES)], "row_idx long, ref string, text string, arabic string").coalesce(1).cache()


@pytest.fixture(scope="module")
def index(passages, tmp_path_factory):
    return PassageIndex.build(passages, path=f"file://{tmp_path_factory.mktemp('ix')}")


@pytest.fixture(scope="module")
def retriever(index):
    return Retriever(index)


def refs(hits):
    return [r["ref"] for r in hits.collect()]


def test_relevant_first_and_off_topic_declined(retriever):
    assert refs(retriever.search("patience in prayer"))[0] == "2:153"
    assert refs(retriever.search("kubernetes deployment")) == [] and refs(retriever.search("")) == [] and refs(retriever.search("the of and")) == []


def test_all_mode_holds_every_occurrence_and_k_is_kept(retriever):
    got = retriever.search("forgiveness", mode="all").collect()
    assert {r["ref"] for r in got} == {"3:134", "39:53"} and all("keyword" in r["matched"] for r in got)
    assert len(refs(retriever.search("forgive mercy patience", top_k=2))) == 2
    scores = [r["score"] for r in retriever.search("mercy forgive", mode="all").collect()]
    assert scores == sorted(scores, reverse=True)


def test_arabic(retriever):
    assert refs(retriever.search("العالمين", mode="all")) == ["1:2"] and refs(retriever.search("الرحمن", mode="all")) == ["1:3"]
    assert refs(retriever.search("من", mode="all")) == [] and refs(retriever.search("الحمد لله العظيم", mode="all")) == ["1:2"]


def test_synonyms_are_alternatives(spark, index):
    qu = understand.QueryUnderstanding(spark, {"musa": 1, "story": 1})
    assert refs(Retriever(index, synonyms=qu.synonym_map()).search("moses", mode="all")) == ["20:9"]


def test_vectors(spark, passages):
    vec = spark.createDataFrame([(i, v[0], [1.0, float(i)]) for i, v in enumerate(VERSES)], "row_idx long, ref string, embedding array<float>")
    ix = PassageIndex.build(passages, vec)
    assert ix.problem == "" and refs(Retriever(ix, lambda q: [1.0, 0.0]).search("zzz", top_k=1)) == ["1:1"]
    for bad in (lambda q: [1.0], lambda q: [[1.0, 0.0]], lambda q: [0.0, 0.0], lambda q: 1 / 0, lambda q: None):
        assert refs(Retriever(ix, bad).search("zzz")) == []
    off = PassageIndex.build(passages, vec.withColumn("ref", vec.ref.substr(1, 0)))
    assert off.vectors is None and "differs at index 0" in off.problem
    assert alignment(vec.limit(3), passages).first()["mismatch"] == "3 indexed vs 10 passages"


def test_empty_corpus(spark):
    none = spark.createDataFrame([], "row_idx long, ref string, text string")
    assert refs(Retriever(PassageIndex.build(none)).search("mercy")) == []


def test_answers(spark, retriever):
    a = answer.GroundedAnswerer(retriever, "the Book")
    got = a.ask("patience")
    assert got.found and got.text.startswith("[2:153] Seek help") and got.citations[0]["ref"] == "2:153"
    none = a.ask("kubernetes")
    assert not none.found and none.citations == [] and "the Book" in none.text
    seen = {}
    model = answer.MockModel(lambda s, u: seen.update(s=s, u=u) or "composed")
    got = answer.GroundedAnswerer(retriever, "the Book", model).ask("patience", compose=True)
    assert got.text == "composed" and got.citations and "the Book" in seen["s"] and "[2:153]" in seen["u"]
    row = answer.answer_row(retriever.search("patience"), "the Book").first()
    assert row["found"] and row["sources"].startswith("[2:153]")
    p = spark.createDataFrame([("1:1", "text", "")], "ref string, text string, commentary string")
    assert "(no commentary available)" in answer.explain(p, "", answer.MockModel(), "the Book")
    assert answer.get_model()("s", "u") == "u"
    with pytest.raises(ValueError):
        answer.get_model("nobody")
    answer.register_provider("keyed", lambda k, m: answer.MockModel(lambda s, u: f"{k}/{m}"))
    assert answer.get_model("keyed", "k", "m")("s", "u") == "k/m"
    with pytest.raises(ValueError):
        answer.get_model("keyed")


def test_labels_and_strength(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(["keyword"], 1.0), (["keyword-partial", "tfidf"], 0.5), (["semantic"], 0.1), (["tfidf"], 0.01)], "m array<string>, s double")
    got = [tuple(r) for r in rows.select(search.match_label(F.col("m")), search.strength(F.col("s"), F.lit(1.0))).collect()]
    assert got == [("word match", 4), ("word match", 2), ("related by meaning", 1), ("related", 1)]


VOCABULARY = Counter(musa=143, ibrahim=74, isa=26, maryam=34, yusuf=28, dawood=17, haroun=18, salat=93, prayer=5, noah=39, nuh=4, patience=89, forgiveness=104, mercy=120, heart=60, belief=40, receive=20, separate=5, purer=6)


@pytest.fixture(scope="module")
def understanding(spark):
    qu = understand.QueryUnderstanding(spark, VOCABULARY)
    qu.vocabulary = qu.vocabulary.coalesce(1).cache()
    return qu


def test_typos(understanding):
    fixed = {"paitence": "patience", "forgivness": "forgiveness", "mercyy": "mercy", "haert": "heart", "beleif": "belief", "recieve": "receive", "seperate": "separate"}
    assert understanding.analyse(" ".join(fixed)).effective == " ".join(fixed.values())


def test_aliases(understanding):
    reach = {"moses": "musa", "abraham": "ibrahim", "jesus": "isa", "mary": "maryam", "joseph": "yusuf", "david": "dawood", "aaron": "haroun", "prayer": "salat"}
    got = {w.term: w.also for w in understanding.analyse(" ".join(reach)).words}
    assert all(want in got[typed] for typed, want in reach.items())


def test_right_and_unknown_words_stay(understanding):
    got = understanding.analyse("patience mercy forgiveness musa zzzqqxyw the")
    assert got.replaced == [] and got.effective == got.query and not got.unclear
    assert understand.response_of(got)["original"] == got.query and understand.response_of(got)["corrections"] == []


def test_ambiguity_asks(spark):
    got = understand.QueryUnderstanding(spark, {"bear": 10, "bead": 10, "beat": 10}).analyse("beax")
    assert got.unclear and len(got.choices) >= 2 and got.replaced == [] and understand.response_of(got)["needs_confirmation"]
