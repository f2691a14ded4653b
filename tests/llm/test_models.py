"""The trained operators against plain versions, and texts that are long in every way."""

import itertools
import math
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm.decontamination import find_leaks
from docloom.llm.language_id import ContextTrees, identify_languages, train_languages, training_texts
from docloom.llm.near_dedup import near_duplicates
from docloom.llm.personal_data import VOTES, find_personal_data, fit_classifier, fit_labelers, redacted
from docloom.llm.quality_crf import LineModel, line_features, score_quality
from docloom.llm.quality_rules import quality_rules
from docloom.llm.substring_dedup import WINDOW_BASES, remove_repeated_spans
from docloom.llm.textblocks import span_hashes, word_spans
from docloom.llm.workspace import Workspace
from tests.llm import brute


def _rows(texts):
    return [(i, t, None, None, 0, 1, "k", "d") for i, t in enumerate(texts)]


# Personal data


def test_one_address_of_a_million_labels(spark):
    text = "see a@x" + ".b" * 1_000_000 + " end"
    row = find_personal_data(brute.frame(spark, _rows([text]))).select(F.size("base").alias("n"), F.col("base")[0]["end"].alias("end"), F.length(redacted("text", "spans")).alias("size")).first()
    assert (row.n, row.end, row.size) == (1, 2_000_007, len("see <EMAIL> end"))


def test_time_grows_with_the_matches_of_a_text(spark):
    def run(n):
        text = " ".join(f"ué{i}@mail.example.com" for i in range(n))
        began = time.time()
        row = find_personal_data(brute.frame(spark, _rows([text]))).select(F.size("base").alias("n"), F.col("base")[n - 1].alias("last"), redacted("text", "spans").alias("clean")).first()
        assert (row.n, row.last.value) == (n, f"{n - 1}@mail.example.com") and text[row.last.start : row.last.end] == row.last.value
        assert row.clean == " ".join(["ué<EMAIL>"] * n)
        return time.time() - began

    run(10)
    assert run(100_000) < 30


def test_runs_that_match_nothing_take_no_longer(spark):
    texts = ["a" * 1_000_000, "1" * 1_000_000, "+1" + " " * 1_000_000, "a." * 500_000 + "@", "(123) " * 200_000, "DE12 " * 200_000, "123-45-" * 200_000]
    began = time.time()
    assert [r.n for r in find_personal_data(brute.frame(spark, _rows(texts))).select(F.size("spans").alias("n")).collect()] == [0] * len(texts)
    assert time.time() - began < 60


def _proposals():
    """Secrets and what looks like them; telephone numbers and other numbers of their shape."""
    rng = random.Random(4)
    mixed = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    out = []
    for k in range(40):
        out.append((f'the access token = "{mixed(40)}" was lost', {"secret"}))
        out.append((f"built from commit {mixed(40)}, then released", set()))
        out.append((f"the part Antidisestablishmentarianism{k} is out of stock", set()))
        out.append((f"call ({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)} today", {"local_phone"}))
        out.append((f"invoice 0{rng.randint(10, 99)}.1{rng.randint(10, 99)}.{rng.randint(1000, 9999)}% of it", set()))
    out.append(("pay to IBAN DE89 3704 0044 0532 0130 00 now", {"iban"}))
    out.append(("his SSN is 123-45-6789, keep it", {"national_id"}))
    return out


def test_the_classifier_refuses_spans_that_the_pattern_takes(spark):
    cases = _proposals()
    got = {r.doc_id: {s.kind for s in r.spans} for r in find_personal_data(brute.frame(spark, _rows([t for t, _ in cases]))).collect()}
    assert [got[i] for i in range(len(cases))] == [kinds for _, kinds in cases]


def test_labelers_and_classifier_equal_their_definitions():
    counts = {(1, 1, 0, 1, 0): 30, (0, 0, -1, 0, -1): 50, (0, 0, 0, 0, 0): 9, (1, 0, -1, 0, 0): 2}
    post = fit_labelers(counts)
    assert post[1, 1, 0, 1, 0] > 0.99 and post[0, 0, -1, 0, -1] < 0.01
    rows = [((*v, size, 1, 1, 1), n) for v, n in counts.items() for size in (3,)]
    bias, weights = fit_classifier(rows, post)
    good = sum(n * post[v] for v, n in counts.items())
    bad = sum(counts.values()) - good
    assert bias == pytest.approx(math.log((good + 1) / (bad + 1)))
    for k in range(len(VOTES)):
        values = sorted({v[k] for v in counts})
        for value in values:
            g = sum(n * post[v] for v, n in counts.items() if v[k] == value)
            b = sum(n * (1 - post[v]) for v, n in counts.items() if v[k] == value)
            assert weights[k, value] == pytest.approx(math.log((g + 1) / (good + len(values)) * (bad + len(values)) / (b + 1)))


def test_columns_that_clash_are_refused(spark):
    with pytest.raises(ValueError, match="spans"):
        find_personal_data(brute.frame(spark, []).withColumn("spans", F.lit(1)), keep=("spans",))


# Languages


def _plain_ppm(samples):
    """Dictionaries of what followed each context of 0 to 3 bytes."""
    model = {}
    for lang, texts in samples.items():
        table = {}
        for t in texts:
            data = b"\n\n\n" + t.encode()
            for i in range(3, len(data)):
                for order in range(4):
                    table.setdefault(data[i - order : i], Counter())[data[i]] += 1
        model[lang] = table
    return model


def _plain_bits(table, text):
    data, total = b"\n\n\n" + text.encode(), 0.0
    for i in range(3, len(data)):
        for order in (3, 2, 1, 0, -1):
            if order < 0:
                total += 8
                break
            seen = table.get(data[i - order : i])
            if not seen:
                continue
            whole = sum(seen.values()) + len(seen)
            if data[i] in seen:
                total -= math.log2(seen[data[i]] / whole)
                break
            total -= math.log2(len(seen) / whole)
    return total


def test_code_lengths_equal_a_plain_ppm():
    rng = random.Random(2)
    make = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    samples = {"x": [make("abcd é", 400), "ab", "", "\n"], "y": [make("bdef\n ", 300)], "z": []}
    trees, plain = ContextTrees(samples), _plain_ppm(samples)
    texts = [make("abcdefé \n", rng.randint(0, 60)) for _ in range(60)] + ["", "中文", "q" * 500]
    raw = [t.encode() for t in texts]
    got = trees.code_lengths(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx([_plain_bits(plain[lang], t) for lang in trees.langs])


def test_whole_texts_teach(spark):
    """The second language shows itself only far behind the start of its texts."""
    rows = [(i, ("k" * 9000 + (" ou la que" if i % 2 else " the and of") * 300), "fr" if i % 2 else "en", None, 0, 1, "k", "d") for i in range(60)]
    rows += [(1000, "ou la que ou la que", None, None, 0, 1, "k", "d"), (1001, "the and of the and of", None, None, 0, 1, "k", "d")]
    got = {r.doc_id: r.lang_pred for r in identify_languages(brute.frame(spark, rows)).collect()}
    assert (got[1000], got[1001]) == ("fr", "en")


def test_samples_are_bounded_whatever_repeats(spark):
    rows = [(None, "the same text again", "en")] * 5000 + [(i, f"text {i} " + "w" * 100, "en") for i in range(3000)] + [(i, f"texte {i}", "fr") for i in range(5)]
    rows += [(9999, "x" * 200_000, "fr")]
    docs = spark.createDataFrame(rows, "id long, text string, lang string")
    got = training_texts(docs, "lang", 100, 100_000).collect()
    by = Counter(r.lang for r in got)
    assert 10 < by["en"] < 200 and by["fr"] >= 1 and len(got) == len({(r.lang, r.text) for r in got})
    assert sum(len(r.text) for r in got if r.lang == "en") < 50_200
    many = spark.createDataFrame([(i, f"{i % 40} b", f"l{i % 40}") for i in range(400)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in identify_languages(many.withColumn("text", F.concat("text", "lang"))).collect()} == {f"l{i}" for i in range(40)}
    with pytest.raises(ValueError, match="8 values"):
        identify_languages(many, languages=7)


def test_samples_are_the_smallest_draws(spark):
    """A plain version of the sample: by class the smallest draws under its rate, until the bytes are enough."""
    rng = random.Random(6)
    rows = [(i, "x" * rng.randint(1, 900) + str(i), rng.choice(["a", "a", "a", "b"])) for i in range(900)] + [(1000 + i, "y" * 3_000_000 + str(i), "long") for i in range(6)]
    docs = spark.createDataFrame(rows, "id long, text string, lang string")
    drawn = docs.select("lang", "text", F.expr("pmod(xxhash64(cast(id AS string), text), 1 << 30)").alias("draw")).collect()
    expected = set()
    for lang in "a", "b", "long":
        own = sorted((r.draw, r.text) for r in drawn if r.lang == lang)
        total = sum(len(t) for _, t in own)
        rate = max(own[0][0] + 1, int(min(1.0, 100 / len(own), 10_000 / total) * (1 << 30)))
        taken = 0
        for draw, text in own:
            if draw < rate and taken < 10_000:
                expected.add((lang, text))
                taken += len(text)
    assert {tuple(r) for r in training_texts(docs, "lang", 100, 30_000).collect()} == expected
    assert {lang for lang, _ in expected} == {"a", "b", "long"}


def test_languages_of_few_and_very_long_texts_are_learned(spark):
    words = {"aa": "ka lo mi", "bb": "the of and", "cc": "ou la que", "dd": "zwei ein und"}
    rows = [(i, f"{words[lang]} " * 20 + str(i), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 300)]
    rows += [(5000 + i, "zwei und ein und " * 300_000 + str(i), "dd") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trees = train_languages(docs, "doc_id", "text", "lang")
    assert trees.langs == ["aa", "bb", "cc", "dd"]
    got = {r.doc_id: r.lang_pred for r in identify_languages(docs.where("length(text) < 1000").unionByName(spark.createDataFrame([(1, "ein und zwei", None)], docs.schema))).collect()}
    assert set(got.values()) == {"aa", "bb", "cc"}  # no long text is there to learn from
    asked = docs.unionByName(spark.createDataFrame([(9001, "und ein zwei", None), (9002, "que la ou", None)], docs.schema))
    got = {r.doc_id: r.lang_pred for r in identify_languages(asked).where("doc_id > 9000").collect()}
    assert got == {9001: "dd", 9002: "cc"}


# Quality


def _plain_score(model, text):
    buf = np.frombuffer(text.encode(), np.uint8)
    x, size, line = line_features(buf, np.array([0, len(buf)]))
    emission = x @ model.weights
    total, good = 0.0, np.zeros(len(emission))
    for ys in itertools.product((0, 1), repeat=len(emission)):
        w = math.exp(sum(emission[k] for k, y in enumerate(ys) if y) + sum(model.jumps[p, q] for p, q in itertools.pairwise(ys)))
        total += w
        good += w * np.array(ys)
    mean = float(((good / total) * (size + 1)).sum() / (size + 1).sum())
    mean = min(max(mean, 1e-4), 1 - 1e-4)
    return 1 / (1 + math.exp(-(model.slope * math.log(mean / (1 - mean)) + model.bias)))


def test_quality_scores_equal_enumeration():
    rng = random.Random(8)
    fine = ["the cat sat on the mat and saw\nthat all was well with it", "one more line of plain words\nand another one of them"]
    junk = ["BUY!!! ### $$$\nNOW!!! %%%", "### ### ###\n*** 123 $$$"]
    model = LineModel(fine * 5 + junk * 5, [1] * 10 + [0] * 10, 40)
    texts = ["\n".join(rng.choice([*fine, *junk, ""]).split("\n")[0] for _ in range(rng.randint(1, 7))) for _ in range(20)] + ["", "\n\n"]
    raw = [t.encode() for t in texts]
    got = model.score(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert got == pytest.approx([_plain_score(model, t) for t in texts])


def test_lines_beyond_the_first_teach(spark):
    """Good and bad texts of this table differ from their hundredth line on."""
    plain, junk = "the cat sat on the mat with it", "BUY!!! ### $$$ %%% NOW!!!"
    rows = [(i, "\n".join([plain] * 100 + [junk if i % 2 else plain + " again"] * 60), None, None, 0, 1, "k", "d") for i in range(80)]
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(80)], "doc_id long, quality int, toxic int")
    got = score_quality(brute.frame(spark, rows), labels).collect()
    assert min(r.score for r in got if r.doc_id % 2 == 0) > max(r.score for r in got if r.doc_id % 2)


def test_good_votes_overrule_a_bad_one(spark):
    """Texts that repeat between two and five tenths of their words break one rule, and are kept; junk is not."""
    rng = random.Random(3)
    words = ["the", "of", "ananor", "tionly", "erst", "to", "in", "reded", "hathe", "on", "wisely", "a"]
    prose = lambda n: [rng.choice(words) + rng.choice(["", "er", "ly", "ing"]) for _ in range(n)]
    rows = [(i, " ".join(prose(120)), None, None, 0, 1, "k", "d") for i in range(300)]
    echo = []
    for i in range(300, 306):
        half = [f"w{k}x" for k in range(100)]
        echo.append((i, " ".join([*[f"u{k}y" for k in range(60)], *half[:28], *half[:28]]), None, None, 0, 1, "k", "d"))
    junk = [(i, " ".join(w + "$$$" for w in prose(120)), None, None, 0, 1, "k", "d") for i in range(400, 440)]
    # The same good votes, and no bad one.
    plain = (399, " ".join([*[f"u{k}y" for k in range(60)], *[f"w{k}x" for k in range(28)], *[f"v{k}x" for k in range(28)]]), None, None, 0, 1, "k", "d")
    got = {r.doc_id: r for r in quality_rules(brute.frame(spark, [*rows, *echo, plain, *junk])).collect()}
    for i, *_ in echo:
        r = got[i]
        assert 5 * r.n_repeat_words > 2 * r.n_words and not r.base_failed and r.kept and r.quality_probability < got[399].quality_probability
    assert not any(got[i].kept for i, *_ in junk)


# Ids, hashes and hot groups


def _string_ids(rows):
    return [(f"d{r[0]:06d}" if r[0] is not None else None, *r[1:]) for r in rows]


SCHEMA = brute.SCHEMA.replace("doc_id long", "doc_id string")


def test_string_ids(spark):
    rows = brute.awkward_documents(5, 40)
    docs = spark.createDataFrame(_string_ids(rows), SCHEMA)
    name = lambda i: f"d{i:06d}"
    expected = brute.components(rows)
    for r in near_duplicates(docs, percent=85).where("doc_id IS NOT NULL").collect():
        assert (r.n_shingles, r.component_id) == (expected[int(r.doc_id[1:])][0], name(expected[int(r.doc_id[1:])][1]))
    repeats = brute.without_repeats(rows)
    for r in remove_repeated_spans(docs).where("doc_id IS NOT NULL").collect():
        assert (r.n_words, r.n_removed, r.kept_text) == repeats[int(r.doc_id[1:])]
    item = brute.words(rows[0][1] or rows[1][1])[:20]
    bench = spark.createDataFrame([("item", " ".join(item))], "item_id string, text string")
    got = find_leaks(docs, bench)
    assert dict(got.dtypes)["item_id"] == dict(got.dtypes)["doc_id"] == "string"
    assert {r.item_id for r in got.collect()} <= {"item"}
    small = spark.createDataFrame(rows, brute.SCHEMA).withColumn("doc_id", F.col("doc_id").cast("int"))
    assert dict(near_duplicates(small).dtypes)["component_id"] == "int"


def test_long_words_of_a_rule_do_not_collide(spark):
    """Words built by the Thue-Morse rule have one value in any polynomial modulo a power of two."""
    a = "a"
    for _ in range(10):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    buf = np.frombuffer(f"{a} {b}".encode(), np.uint8)
    starts, ends, _ = word_spans(buf, np.array([0, len(buf)]))
    assert len(set(span_hashes(buf, starts, ends).tolist())) == 2
    rest = " ".join(f"w{k}" for k in range(4))
    got = {r.doc_id: r.component_id for r in near_duplicates(brute.frame(spark, _rows([f"{a} {rest}", f"{b} {rest}"]))).collect()}
    assert got == {0: 0, 1: 1}


def test_hashes_of_words_longer_than_a_piece():
    word = "q" * 1_300_000
    for before in ("", "z z z z z "):
        buf = np.frombuffer((before + word + " " + word[:-1] + "r").encode(), np.uint8)
        starts, ends, _ = word_spans(buf, np.array([0, len(buf)]))
        got = span_hashes(buf, starts, ends)[-2:].tolist()
        assert got[0] != got[1]
        if not before:
            first = got
    assert got == first


def test_copies_and_blanks_in_great_numbers(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = _rows([text] * 3000 + [""] * 3000 + [None] * 10 + [text + " more"] * 50 + [f"own words {i} of nobody else" for i in range(200)])
    got = {r.doc_id: r for r in near_duplicates(brute.frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert {got[i].component_id for i in range(3000)} == {0} == {got[i].component_id for i in range(6010, 6060)}
    assert all(got[i].component_id == i for i in (*range(3000, 6010), *range(6060, 6260)))


def test_a_failed_source_is_made_good_by_another_hash(spark, monkeypatch):
    """With the first hash blind to all but a window's first word, smallest sources are wrong; the next hash finds the right ones."""
    from docloom.llm import substring_dedup as S

    real = S.window_hashes
    monkeypatch.setattr(S, "WINDOW_BASES", (0, *WINDOW_BASES[1:]))
    rng = random.Random(6)
    passage = ["key"] + [f"p{k}" for k in range(20)]
    other = ["key"] + [f"o{k}" for k in range(20)]
    rows = [(0, " ".join(other)), (1, " ".join(passage)), (2, " ".join(["x", *passage, "y"])), (3, " ".join(["u", *other]))]
    rows += [(10 + i, " ".join(f"r{rng.randrange(10**6)}" for _ in range(40))) for i in range(5)]
    assert real is S.window_hashes
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in remove_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.without_repeats(rows)


def test_spans_that_no_hash_proves_are_an_error(spark, monkeypatch):
    """With hashes that are all blind but for the first word, two sources stay confused; nothing is returned in silence."""
    from docloom.llm import substring_dedup as S

    monkeypatch.setattr(S, "WINDOW_BASES", (0, 0))
    other, passage = (" ".join(["key", *[f"{c}{k}" for k in range(20)]]) for c in "op")
    rows = [(0, other), (1, passage), (2, f"x {passage} y"), (3, f"u {other}")]
    with pytest.raises(RuntimeError, match="under none of 2 hashes"):
        remove_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"))


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

    class Session:
        sparkContext = Context()  # noqa: N815

        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        Workspace(Session(), "x")
