import pytest
from frames import WILD_IDS, empty, ids, wild
from tessera.llm import quality, toxicity
from tessera.llm.common import BoundedCache
from tessera.llm.labelled import training_sample

LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{LARGER}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{LARGER}/labels.parquet")


@pytest.fixture(scope="module")
def model(docs, labels):
    return quality.fit_quality(docs, labels)


@pytest.fixture(scope="module")
def lexicon(docs, labels):
    return toxicity.fit_lexicon(docs, labels)


def right(scored, labels, label, only=None):
    rows = scored.where("held_out").join(labels, "doc_id").where(only or "true").collect()
    return sum(r.predicted == r[label] for r in rows) / len(rows)


def test_quality_of_held_out_rows(docs, labels, model):
    scored = quality.score_quality(docs, model)
    assert right(scored, labels, "quality") >= 0.95
    assert scored.count() == docs.count()


def test_toxicity_of_held_out_rows(docs, labels, lexicon):
    assert right(toxicity.score_toxicity(docs, lexicon), labels, "toxic") >= 0.93


def test_votes_against_plain_cosines(docs, model):
    import numpy as np

    texts = [r.text for r in docs.limit(40).collect()]
    counts = quality._counted(texts, quality._words_terms())
    for row, score in zip(counts, quality._votes(model, counts)):
        weighted = row * model.idf
        at = (weighted / np.linalg.norm(weighted)) @ model.axes
        near = np.round((model.vectors @ (at / np.linalg.norm(at))).astype(float), 5)
        chosen = near >= np.sort(near)[-quality.NEIGHBOURS]
        vote = np.where(chosen, np.maximum(near, 0) ** quality.SHARPNESS, 0) * model.weights
        assert abs((vote * model.labels).sum() / vote.sum() - score) < 0.02


def test_sample_is_bounded_and_leaves_held_out_rows_alone(docs, labels):
    sample, weights = training_sample(docs, labels, "quality", 10)
    rows = sample.collect()
    assert sorted(r.label for r in rows) == [0] * 10 + [1] * 10
    import zlib

    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 for r in rows)
    assert weights[1] > weights[0] >= 1


@pytest.mark.parametrize("which", ["quality", "toxicity"])
def test_odd_rows(spark, model, lexicon, which):
    score = (lambda d: quality.score_quality(d, model)) if which == "quality" else (
        lambda d: toxicity.score_toxicity(d, lexicon))
    rows = score(wild(spark)).collect()
    assert ids(rows) == WILD_IDS
    assert all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    by_id = {}
    for row in rows:
        by_id.setdefault(row.doc_id, set()).add(row.score)
    assert by_id[2] == by_id[3] and by_id[1] == by_id[6] and len(by_id[6]) == 1
    assert score(empty(spark)).count() == 0


def test_nothing_to_learn_from(spark, docs, labels):
    none = labels.where("false")
    assert {r.score for r in quality.score_quality(docs, quality.fit_quality(docs, none)).collect()} == {0.5}
    assert all(r.score < 1e-9 for r in toxicity.score_toxicity(docs, toxicity.fit_lexicon(docs, none)).collect())


def test_keeping_leaves_the_columns(spark, model):
    kept = quality.keep_quality(wild(spark), model)
    assert kept.columns == wild(spark).columns and kept.count() <= wild(spark).count()


def test_folding():
    assert toxicity.fold("1D10T, l0$er!") == "idiot, loser!"
    assert toxicity.fold("іdіоt") == "idiot"
    assert toxicity.fold("ｉｄｉｏｔ") == "idiot"
    assert toxicity.fold("id\u200biot") == "idiot"
    assert toxicity.fold("call 1045 now") == "call 1045 now"
    assert toxicity.fold("été") == "été"


def test_entries_exceptions_and_length():
    lexicon = toxicity.Lexicon({" idiot ": 4.0, " sc": 2.0, " scum": 5.0}, frozenset({"idiot proof"}))
    automaton = lexicon.automaton()

    def weight(text):
        return toxicity.toxic_weight(text, lexicon, automaton)

    assert weight("an idiotic day") == (0.0, 0.0)
    assert weight("you 1d10t") > (0.0, 0.0)
    assert weight("an idiot proof plan") == (0.0, 0.0)
    assert weight("scum")[0] == 5.0 / 21**0.5
    assert weight("scum " * 50)[1] == 20 * 15.0 / 70
    assert weight("idiot " + "word " * 500) < weight("idiot " + "word " * 5)
    assert weight("") == (0.0, 0.0)


def test_words_count_to_their_end():
    words_terms = quality._words_terms()
    start = "漢字、" * 100
    texts = [start + "漢字", start + "漢字" + "7;{" * 50, start + "漢字" + "a=7" * 50, start + "漢字!"]
    assert len({words_terms[t] for t in texts}) == len(texts)
    assert quality._term("sign {") in words_terms[texts[1]] and quality._term("end x!") in words_terms[texts[3]]
    counts = quality._counted(texts, words_terms)
    assert len({row.tobytes() for row in counts}) == len(texts)
    assert words_terms["isn't"] == tuple(map(quality._term, ["shape a'a", "end 'a", "length 1", "sign '"]))


def test_repeated_ids_are_one_row_of_the_sample(spark):
    docs = spark.createDataFrame([(1, f"text {i % 3}") for i in range(60)] + [(1, None), (2, "other"), (3, None)],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "doc_id long, quality int")
    rows = training_sample(docs, labels, "quality", 10)[0].collect()
    assert sorted((r.doc_id, r.label) for r in rows) == [(1, 0), (2, 1), (3, 1)]
    assert {r.doc_id: r.text for r in rows}[1].startswith("text")


def test_terms_of_a_shape_are_made_once(monkeypatch):
    """Words of one shape share their terms, which are those of a plain loop over characters."""
    make, made = quality._shape_terms, []
    monkeypatch.setattr(quality, "_shape_terms", lambda *key: made.append(key[:2]) or make(*key))
    word_terms = quality._WordTerms(BoundedCache(quality._term, 1000))

    def plain(word):
        shape = []
        for c in word:
            kind = "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "x" if c.isalpha() else c
            if not shape or shape[-1] != kind:
                shape.append(kind)
        names = [f"shape {''.join(shape[i : i + 12])}" for i in range(0, len(shape), 12)]
        names += [f"end {''.join(shape[-2:])}", f"length {min(len(word), 40) // 4}"]
        names += [f"sign {s}" for s in dict.fromkeys(shape) if s not in "aA0x"]
        return tuple(map(quality._term, names + ([f"word {word.lower()}"] if len(word) <= 4 else [])))

    words = ["plain", "words", "Word", "İİ", "ßé", "漢字、漢字", "a--b", "a\x00\x00", "\x1c\x1c7", "²²x", "(isn't)", "ǅa", "x" * 500,
             "aB0." * 300, "é" * 9, "\U0010ffff\U0010ffff"]
    for _ in range(2):
        assert [word_terms(w) for w in words] == list(map(plain, words))
    short = [key for key in made if len(key[0]) <= 64]
    assert len(short) == len(set(short)) < len(words)


def test_words_in_use_stay_known(monkeypatch):
    words_terms = quality._words_terms()
    monkeypatch.setattr(words_terms, "limit", 8)
    made, compute = [], words_terms.compute
    monkeypatch.setattr(words_terms, "compute", lambda word: made.append(word) or compute(word))
    for n in range(100):
        quality._counted([f"oftenasked rare{n}word other{n}word"], words_terms)
    assert made.count("oftenasked") == 1
