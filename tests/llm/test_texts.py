"""Languages, quality, toxicity, private data, packing and token files."""

from __future__ import annotations

import hashlib
import pickle
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from runledger.llm import arrays, language, packing, pii, quality, token_files, toxicity
from runledger.llm.tokens import Encoder, tokenizer_path
from tests.llm import plain
from tests.llm.conftest import by_id, texts


def test_private_data(documents, odd):
    for table in (documents, odd):
        found = by_id(pii.digest(table), "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
        for i, text in texts(table).items():
            spans = plain.private_spans(text)
            kinds = [k for k, _, _ in spans]
            assert found[i] == (*(kinds.count(k) for k in pii.BASE_KINDS), plain.sha(",".join(f"{k}:{s}:{e}" for k, s, e in spans)))


def test_private_data_of_the_method():
    text = "see https://example.org/x. IBAN DE89 3704 0044 0532 0130 00; account no. 12345678; 12 Green Park Road"
    found = {(kind, text[start:end]) for kind, start, end in pii.find(text)}
    assert {("url", "https://example.org/x"), ("account", "DE89 3704 0044 0532 0130 00"), ("account", "12345678"), ("address", "12 Green Park Road")} <= found
    assert pii.find("IBAN DE89 3704 0044 0532 0130 01") == []


def test_redaction(odd):
    cleaned = pii.redact(odd)
    assert cleaned.columns == odd.columns
    found = {r.doc_id: r for r in cleaned.collect()}
    assert found[10].text is None
    assert found[30].text.startswith("Mail <email>, <ip>, 300.1.1.1, <card>, <phone> or x@y. <url>")
    assert found[30].n_chars == len(found[30].text)


def test_quality_counts(documents, odd, labels):
    for table in (documents, odd):
        found = by_id(quality.judge(table, labels), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
        for i, text in texts(table).items():
            counts = plain.quality_counts(text)
            failed = counts[0] < 20 or 100 * counts[4] > 30 * counts[0]
            assert found[i][:6] == (*counts, failed)
            assert not (failed and found[i][6])


def test_binomial_bounds_are_exact():
    assert quality.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100), abs=1e-9)
    assert quality.upper_bound(5, 5, 0.05) == 1.0
    for k, n, delta in ((3, 50, 0.05), (10, 1000, 1e-5)):
        assert quality._binomial_at_most(k, n, quality.upper_bound(k, n, delta)) == pytest.approx(delta, rel=1e-6)
        assert quality._within(k, n, quality.upper_bound(k, n, delta) + 1e-9, delta)
        assert not quality._within(k, n, quality.upper_bound(k, n, delta) - 1e-6, delta)


def test_cutoffs_keep_good_documents(spark):
    """Bad documents are full of symbols; a few good ones are, but not more than the bound allows."""
    rows, labels = [], []
    for i in range(6000):
        bad = i % 5 == 0
        words = [f"word{(i * 31 + j * j) % 977}" for j in range(40)]
        rows.append((i, " ".join(["###" if bad and j % 2 else w for j, w in enumerate(words)])))
        labels.append((i, 0 if bad else 1))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    chosen = quality.select_cutoffs(quality.measure(docs), marks).collect()
    assert any(r.measure == "symbol_share" for r in chosen)
    assert sum(r.false_rejection_bound for r in chosen) <= 0.05 + 1e-9
    judged = quality.judge(docs, marks).join(marks, "doc_id")
    assert judged.where("quality = 0 AND kept").count() == 0
    assert judged.where("quality = 1 AND NOT kept").count() <= 0.05 * 4800
    assert quality.judge(docs, marks.limit(0)).where("NOT kept").count() == quality.judge(docs, marks.limit(0)).where("base_failed").count()


def test_cutoffs_equal_a_plain_selection(spark):
    """Cutoffs from the table of documents against a selection over lists; copies of a text count once, as good if any is."""
    draw = random.Random(3)
    rows, marks = [], []
    for i in range(2600):
        bad = i % 4 == 0
        share = draw.random() * (0.9 if bad else 0.35 if i % 50 == 1 else 0.05)
        words = ["".join(draw.choices("abcdef", k=5)) + str(i) if draw.random() > share else "#" * 6 for _ in range(30)]
        rows.append((i, " ".join(words)))
        marks.append((i, 0 if bad else 1))
    twice = [(10_000 + i, rows[i * 4][1]) for i in range(40)] + [(20_000 + n, rows[51][1]) for n in range(300)]
    marks += [(i, 0) for i, _ in twice[:40]] + [(i, 1) for i, _ in twice[40:]] + [(0, None), (4, 7)]
    docs, labels = spark.createDataFrame(rows + twice, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int")
    stats = quality.measure(docs)
    chosen = {(r.stratum, r.measure): r.cutoff for r in quality.select_cutoffs(stats, labels).collect()}
    label = {}
    for i, mark in marks:
        text = dict(rows + twice)[i] if mark in (0, 1) else None
        if text is not None:
            label[text] = max(label.get(text, 0), mark)
    good, bad = [], []
    for text, mark in label.items():
        counts = plain.quality_counts(text)
        if counts[0] >= 20 and 100 * counts[4] <= 30 * counts[0]:
            (good if mark else bad).append(round(counts[2] / len(text), 6))
    assert chosen[0, "symbol_share"] == plain.cutoff(good, bad, 0.05 / 6, 0.05 / 24, quality.CUTOFFS)
    assert all(s == 0 for s, _ in chosen)


def test_a_cutoff_in_use_seldom_exceeds_its_rate():
    """Over 200 holdouts from a known distribution fewer choices break the rate than delta allows."""
    draw, broken, used = random.Random(11), 0, 0
    alpha, delta, n = 0.05, 0.1, 200
    for _ in range(200):
        # Good values are uniform: a cutoff c rejects a part 1 - c of them.
        good, bad = sorted(draw.random() for _ in range(n)), sorted(draw.random() ** 0.3 for _ in range(n))
        above = lambda values: [sum(v > c for v in values) for c in quality.CUTOFFS]
        i = quality.best_cutoff(above(good), above(bad), n, alpha, delta)
        used += i is not None
        broken += i is not None and 1 - quality.CUTOFFS[i] > alpha + 1e-9
    assert used > 100
    assert broken <= 200 * delta


def test_languages(documents, odd):
    found = language.identify(documents).join(documents.select("doc_id", "lang"), "doc_id")
    assert found.where("held_out").count() > 30
    assert found.where("held_out AND lang_pred != lang").count() <= 1
    assert found.where("score < 0 OR score > 1").count() == 0
    got = by_id(language.identify(odd), "lang_pred", "score")
    assert {got[i] for i in (10, 11, 12, 16)} == {("und", 0.0)}
    assert got[32][0] in ("en", "de")


def test_language_needs_only_the_text(documents):
    shuffled = documents.withColumn("source", F.lit("z")).withColumn("lang", F.when(language.held_out(), F.lit(None)).otherwise(F.col("lang")))
    one, other = (by_id(language.identify(x), "lang_pred", "score") for x in (documents, shuffled.repartition(5)))
    assert {i: v[0] for i, v in one.items()} == {i: v[0] for i, v in other.items()}
    assert all(abs(one[i][1] - other[i][1]) < 1e-6 for i in one)


def test_unknown_languages_go(odd, documents):
    kept = language.keep_known(odd)
    assert kept.columns == odd.columns
    assert not {r.doc_id for r in kept.collect()} & {10, 11, 12, 16}
    assert language.keep_known(documents).count() >= 0.98 * documents.count()


@pytest.mark.parametrize("n", [2, 3, 4, 5, 9, 40])
def test_codewords_differ(n):
    code = language.codewords(n)
    assert len({tuple(r) for r in code.tolist()}) == n
    assert all(abs(c.sum()) < n for c in code.T)


def test_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.score(docs, labels)
    assert found.count() == docs.count()
    assert found.where("score < 0 OR score > 1 OR predicted != int(score >= 0.3)").count() == 0
    known = found.join(labels, "doc_id").where("held_out")
    assert known.where("toxic = 0 AND predicted = 1").count() <= 0.03 * known.where("toxic = 0").count()
    hidden = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert by_id(found, "score") == by_id(toxicity.score(docs, hidden), "score")


def _ids(held, start):
    """Ids from start on that are held out or not."""
    return (i for i in range(start, 1 << 30) if (zlib.crc32(str(i).encode()) % 4 == 2) == held)


def test_held_out_toxic_recall(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    known = toxicity.score(docs, labels).join(labels, "doc_id").where("held_out AND toxic = 1")
    assert known.where("predicted = 1").count() >= 0.75 * known.count()


def test_toxic_copy_in_a_rare_language(spark):
    """Three labelled rows are too few for any of their words to be significant; a near copy is still found."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    known, hidden = _ids(False, 10**7), _ids(True, 10**7)
    toxic = [(next(known), " ".join(f"qx{n}{chr(97 + i % 26)}{chr(97 + i // 26)}zu" for i in range(60))) for n in range(3)]
    copies = [(next(hidden), text + " mno") for _, text in toxic]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(toxic + copies, "doc_id long, text string"))
    labels = labels.select("doc_id", "toxic").union(spark.createDataFrame([(i, 1) for i, _ in toxic], "doc_id long, toxic int"))
    got = by_id(toxicity.score(docs, labels), "predicted", "evidence")
    for (copy, _), (example, _) in zip(copies, toxic, strict=True):
        assert got[copy][0] == 1
        nearest, cosine = got[copy][1].split(",")[0].split(":")
        assert int(nearest) == example
        assert float(cosine) > 0.9


def test_repeated_rows_do_not_change_scores(spark, documents, labels):
    toxic = labels.where("toxic = 1").where(~toxicity.held_out()).orderBy("doc_id").limit(1)
    again = documents.join(toxic.select("doc_id"), "doc_id").select("doc_id", "text").join(spark.range(300))
    many = documents.select("doc_id", "text").union(again.select("doc_id", "text"))
    assert many.count() == documents.count() + 300
    assert by_id(toxicity.score(many, labels), "score", "evidence") == by_id(toxicity.score(documents, labels), "score", "evidence")


def test_toxicity_without_labels_or_terms(odd, labels):
    assert {r.score for r in toxicity.score(odd, labels.limit(0)).collect()} == {0.0}
    got = by_id(toxicity.score(odd, odd.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))), "score")
    assert got[10] == got[11] == got[12]


def test_neighbours_are_exact():
    draw = np.random.default_rng(2)
    vectors = []
    for _ in range(500):
        terms = np.sort(draw.choice(60, draw.integers(1, 8), replace=False))
        weight = draw.random(len(terms))
        vectors.append((terms, weight / np.linalg.norm(weight)))
    index, dense = toxicity.Index(vectors, 60), np.zeros((500, 60))
    for slot, i in enumerate(index.order):
        dense[slot, vectors[i][0]] = vectors[i][1]
    for terms, weight in vectors[:60]:
        cosines = dense[:, terms] @ weight
        want = np.lexsort((np.arange(500), -np.round(cosines, 9)))[:16]
        hits = index.nearest(terms, weight, 16)
        assert hits.example.tolist() == [w for w in want if cosines[w] > 0]
        assert np.allclose(hits.cosine, cosines[hits.example])


def test_blocks_that_stay_closed_hold_no_neighbour(monkeypatch):
    """Examples of twelve topics, few of them dense terms: most blocks stay closed, and the neighbours are those of a plain product,
    also of an index that was sent to a worker and with one example left out."""
    monkeypatch.setattr(toxicity, "DENSE", 20)
    draw = np.random.default_rng(5)
    vectors = []
    for i in range(1500):
        terms = np.unique(np.concatenate([draw.integers(0, 30, 6), 30 + i % 12 * 200 + draw.integers(0, 200, 40)]))
        weight = (1 + draw.random(len(terms))).astype(np.float32)
        vectors.append((terms, weight / np.linalg.norm(weight)))
    vectors[700] = vectors[100]
    index = toxicity.Index(vectors, 3000)
    sent = pickle.loads(pickle.dumps(index))
    dense = np.zeros((1500, 3000))
    for i, (terms, weight) in enumerate(vectors):
        dense[i, terms] = weight
    for q in range(0, 1500, 25):
        terms, weight = vectors[q]
        cosines = dense[:, terms] @ weight.astype(np.float64)
        for found, hidden in ((index, -1), (sent, -1), (sent, q)):
            here = np.where(np.arange(1500) == hidden, 0, cosines)
            want = np.lexsort((np.arange(1500), -np.round(here, 9)))[:16]
            hits = found.nearest(terms, weight.astype(np.float64), 16, without=hidden)
            assert hits.example.tolist() == want.tolist()
            assert np.allclose(hits.cosine, here[want], atol=1e-6)
    assert sent.opened < 0.5 * sent.met


def test_blocks_are_not_bounded_where_all_would_open(monkeypatch):
    """Examples without topics: bounds are worked out for the first queries of a batch only, and the neighbours of the others are
    those of one query at a time."""
    monkeypatch.setattr(toxicity, "DENSE", 20)
    draw, bounded, bounds = np.random.default_rng(7), [], toxicity.Query.bounds
    monkeypatch.setattr(toxicity.Query, "bounds", lambda self, *of: bounded.append(self) or bounds(self, *of))
    vectors = []
    for _ in range(600):
        terms = np.sort(draw.choice(300, 40, replace=False))
        weight = draw.random(40)
        vectors.append((terms, weight / np.linalg.norm(weight)))
    index = toxicity.Index(vectors, 300)
    at, (terms, weights) = np.arange(101) * 40, (np.concatenate([v[i] for v in vectors[:100]]) for i in (0, 1))
    left_out = np.where(np.arange(100) % 3, -1, np.arange(100))
    found = list(index.nearest_of(at, terms, weights, 16, left_out))
    assert len(bounded) == toxicity.PROBES
    assert index.met == 100 * 10
    for (own, weight), hits, hidden in zip(vectors, found, left_out, strict=False):
        alone = index.nearest(own, weight, 16, without=hidden)
        assert hits.example.tolist() == alone.example.tolist()
        assert hits.cosine.tolist() == alone.cosine.tolist()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_of_words_are_ids_of_texts(documents, odd, name):
    encoder = Encoder(tokenizer_path(name))
    several = [*texts(documents).values(), *(t or "" for t in texts(odd).values()), "a  b", " a", "a ", "a\n b", "a \n", "a\n\nb", "\tx", "x's don't I'LL"]
    several += ["", "Hm... (so), a.b, x², ΣΑΣ, ΑΣ. İ! no.\nYes, \n-no.\n\n9.", "it's\n's, a.\n.b", "a § b", "§", "x§y §§ †", "a \nb\n c", "\n", "e\u0301 \u0301x", "Ǆ ǅ İ"]
    assert encoder.mark
    for text, ids in zip(several, encoder(several), strict=True):
        assert ids == np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_special_strings_get_the_ids_of_the_library(name):
    from tokenizers import Tokenizer

    plain_one, encoder = Tokenizer.from_file(tokenizer_path(name)), Encoder(tokenizer_path(name))
    several = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y <|startoftext|>.", "<|ENDOFTEXT|> <|endof text|>", "a b <|endoftext|", "A b.\n<|startoftext|> c", "a b, c"]
    for text, ids in zip(several, encoder(several), strict=True):
        assert ids == np.array(plain_one.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    if name.startswith("byte"):
        assert np.frombuffer(next(encoder(several[:1])), "<u4").tolist() == [64, 220, 50256, 275]


def test_the_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr("runledger.llm.tokens.KEPT_WORDS", 50)
    encoder = Encoder(tokenizer_path("word_bpe_49k.json"))
    for i in range(30):
        text = " ".join(f"w{i}x{j}" for j in range(20))
        assert list(encoder([text])) == [np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]
        assert len(encoder.known) + len(encoder.older) <= 2 * 50


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_a_word_is_looked_up_once_for_many_texts(name):
    encode = Encoder(tokenizer_path(name))
    calls, asked, ids, of_words = [], [], encode._ids, encode._of_words
    encode._ids = lambda text: calls.append(text) or ids(text)
    encode._of_words = lambda words: asked.extend(words) or of_words(words)
    given = [f"Same first word, then\n{i % 7} more. " + "and on " * i + "end" for i in range(200)] + ["", " ", "one", " blank before"]
    assert list(encode(given)) == [np.array(encode.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in given]
    assert len(calls) < 20 and len(asked) == len(set(asked)) < 30


def test_each_text_goes_to_python_once(documents, monkeypatch):
    sent, predict = [], language.predict
    monkeypatch.setattr(language, "predict", lambda docs, model, *rest: sent.append(docs) or predict(docs, model, *rest))
    assert language.keep_known(documents).columns == documents.columns
    assert len(sent[0].columns) == len(documents.columns)


def test_workers_give_memory_back(monkeypatch):
    calls = []
    monkeypatch.setattr("runledger.llm.arrays.release", lambda: calls.append(1))
    batches = [pa.RecordBatch.from_arrays([pa.array(["a b", None, ""])], ["text"])] * 3
    assert [len(offsets) for _, _, offsets in arrays.slices(iter(batches))] == [4] * 3 and len(calls) == 3
    assert len(list(Encoder(tokenizer_path("word_bpe_49k.json"))(["a b", "c"]))) == 2 and len(calls) == 4


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_known_words_take_few_bytes(name):
    """Words are kept in Arrow arrays, each in one of the two halves of the memory, and no word has an object of its own."""
    encode = Encoder(tokenizer_path(name))
    given = [" ".join(f"w{i}x{j}, w{j}." for j in range(2000)) for i in range(5)]
    for text in given:
        assert list(encode([text])) == [np.array(encode.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]
    assert len(encode.known) == len(set(encode.known.to_pylist())) > 11000
    assert encode.known.nbytes + encode.known_ids.nbytes < 60 * len(encode.known)


def test_packing(documents, odd):
    encoder = Encoder(tokenizer_path("word_bpe_49k.json"))
    for table in (documents, odd):
        rows = packing.pack(table).collect()
        got = sorted((r.doc_id if r.doc_id is not None else -1, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
        want = []
        for r in table.select("doc_id", "text").collect():
            ids = np.frombuffer(next(encoder([r.text or ""])), "<u4").tolist() + [0]
            for n, at in enumerate(range(0, len(ids), 2048)):
                part = ids[at : at + 2048]
                want.append((r.doc_id if r.doc_id is not None else -1, n, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
        assert got == sorted(want)
        filled = {}
        for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
            assert filled.get(r.sequence_id, 0) == r.offset
            filled[r.sequence_id] = r.offset + r.length
        assert max(filled.values()) <= 2048
        assert len(filled) <= -(-sum(filled.values()) // 2048) * 1.02 + 1


def _fewest(lengths, capacity):
    """Fewest sequences, by trying everything."""
    best = [len(lengths)]

    def go(rest, open_):
        if len(open_) >= best[0]:
            return
        if not rest:
            best[0] = len(open_)
            return
        for i, room in enumerate(open_):
            if room >= rest[0] and room not in open_[:i]:
                go(rest[1:], open_[:i] + [room - rest[0]] + open_[i + 1 :])
        go(rest[1:], [*open_, capacity - rest[0]])

    go(sorted(lengths, reverse=True), [])
    return best[0]


def test_reduction_never_costs_a_sequence():
    draw = np.random.default_rng(4)
    for _ in range(60):
        lengths = draw.integers(1, 21, draw.integers(1, 10)).tolist()
        plan = packing.Plan(np.bincount(lengths, minlength=21), 20)
        reduced = packing.Plan.__new__(packing.Plan)
        reduced.capacity, reduced.left, reduced.used = 20, np.bincount(lengths, minlength=21).astype(np.int64), np.zeros(21, np.int64)
        reduced.slots, reduced.n_sequences = [], 0
        reduced._reduce()
        rest = [n for n in range(21) for _ in range(int(reduced.left[n]))]
        assert reduced.n_sequences + _fewest(rest, 20) == _fewest(lengths, 20)
        assert plan.n_sequences <= _fewest(lengths, 20) * 11 / 9 + 1
        placed = sorted((n, r) for n in range(1, 21) for r in range(lengths.count(n)))
        sequence, offset = plan.place(np.array([n for n, _ in placed]), np.array([r for _, r in placed]))
        used = sorted((s, o, n) for (n, _), s, o in zip(placed, sequence.tolist(), offset.tolist(), strict=True))
        for (s, o, n), (t, p, _) in zip(used[:-1], used[1:], strict=True):
            assert (s == t and p == o + n) or (s < t and p == 0)
        assert all(o + n <= 20 for _, o, n in used)


def test_token_files(spark, documents, odd, tmp_path):
    encoder = Encoder(tokenizer_path("byte_bpe_50k.json"))
    for name, table in (("plain", documents), ("odd", odd)):
        folder = str(tmp_path / name)
        token_files.write(table, folder)
        rows = sorted(table.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
        start, want = 0, []
        for r in rows:
            ids = np.append(np.frombuffer(next(encoder([r.text or ""])), "<u4"), 2).astype("<u4")
            want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
        assert sorted(map(tuple, token_files.summary(spark, folder).collect()), key=lambda r: r[1]) == want
    one = token_files.read(spark, str(tmp_path / "odd"), [30]).collect()
    assert [r.doc_id for r in one] == [30]
    assert one[0].ids == [*np.frombuffer(next(encoder([texts(odd)[30]])), "<u4").tolist(), 2]


def test_a_damaged_dictionary_is_noticed(spark, documents, tmp_path):
    token_files.write(documents.limit(20), str(tmp_path / "a"))
    spark.createDataFrame([(hashlib.sha256(b"x").hexdigest(), bytearray(b"y"))], "sha256 string, dictionary binary").write.mode("overwrite").parquet(str(tmp_path / "a" / "dictionary"))
    with pytest.raises(ValueError, match="damaged"):
        token_files.summary(spark, str(tmp_path / "a"))


def test_tables_without_rows(none, labels, spark):
    for found in (pii.digest(none), pii.redact(none), packing.pack(none), language.identify(none), language.keep_known(none), quality.judge(none, labels), token_files.round_trip(none), toxicity.score(none, labels)):
        assert found.collect() == []


def test_powers_of_any_position_from_a_small_block():
    """What a worker keeps does not grow with the longest text, and the powers are those of repeated products."""
    base = 0x9E3779B97F4A7C15
    for inverse in (False, True):
        step = pow(base, -1, 1 << 64) if inverse else base
        got = arrays.powers(base, 200_000, inverse)
        assert len(got) == 200_001
        assert [int(got[i]) for i in (0, 1, 32_767, 32_768, 100_001, 200_000)] == [pow(step, i, 1 << 64) for i in (0, 1, 32_767, 32_768, 100_001, 200_000)]
    assert sum(x.nbytes for x in arrays._POWERS.values()) < 4 << 20
