"""The operators against plain versions, on a corpus with all that is odd."""

import base64
import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tessera.llm import queries

BLANKS = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def run(spark, tables, name):
    return queries.QUERIES[name](spark, tables)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def base_counts(text):
    words = BLANKS.findall(text or "")
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if BLANKS.search(line):
            dup += line in seen
            seen.add(line)
    grams = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words)


def test_quality_base_counts(spark, tables, corpus):
    out = run(spark, tables, "op1_divergence_rules")
    got = {r[0]: r[1:] for r in rows_of(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")}
    assert len(got) == len(corpus)
    for doc_id, text, *_ in corpus:
        assert got[doc_id][:6] == base_counts(text), doc_id
        assert not (got[doc_id][5] and got[doc_id][6])
    assert sum(got[k][6] for k in range(60)) == 60
    symbols = next(r[0] for r in corpus if r[1] and "***" in r[1])
    assert not got[symbols][6]


def test_verdicts_against_a_plain_version(spark, tables, corpus):
    """Histograms, references and distances in numpy."""
    from tessera.llm import divergence as D

    split = lambda t: BLANKS.findall(t or "")
    names = max(map(len, D.COMMON.values()))

    def shares(x):
        return np.asarray(x) / sum(x) if sum(x) else np.zeros(len(x))

    def histograms(text, lang):
        text = text or ""
        kind = collections.Counter("upper" if c.isupper() else "letter" if c.isalpha() else "digit" if c.isdecimal() else "stop" if c in ".,;:!?'\"()-" else "symbol" if c in "#*$%&|<>" else "blank" if c in " \t\n\x0b\f\r" else "other" for c in text if not "a" <= c <= "z")
        lower = sum("a" <= c <= "z" for c in text)
        chars = shares([lower, kind["upper"], kind["letter"], kind["digit"], kind["stop"], kind["symbol"], kind["blank"], kind["other"]])
        known = D.COMMON.get(lang, [])
        hits = [known.index(w) for w in re.split(r"[\x20\x09-\x0D.,;:!?]+", text.lower()) if w in known]
        counts = [hits.count(k) for k in range(names)]
        return chars, shares([*counts, max(0, len(split(text)) - len(hits))])

    def distance(p, q):
        m = (p + q) / 2
        part = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m) if a > 0)
        return math.sqrt(max(0, (part(p) + part(q)) / 2))

    rows = [(k, t, lang or "") for k, t, lang, *_ in corpus]
    facts = {k: (t or "", lang, histograms(t, lang), base_counts(t)) for k, t, lang in rows}
    refs = {}
    for lang in {x[1] for x in facts.values()}:
        clean = list({t: h for t, l, h, b in facts.values() if l == lang and not b[5]}.values())
        if not clean:
            continue
        mean = [np.mean([h[i] for h in clean], axis=0) for i in (0, 1)]
        far = [max(distance(h[0], mean[0]), distance(h[1], mean[1])) for h in clean]
        middle = sorted(far)[(len(far) + 1) // 2 - 1]
        near = [h for h, f in zip(clean, far) if f <= middle + 1e-12]
        refs[lang] = (len(near), [np.mean([h[i] for h in near], axis=0) for i in (0, 1)])
    got = {r[0]: r[1:] for r in rows_of(run(spark, tables, "op1_divergence_rules"), "doc_id", "char_distance", "word_distance", "kept")}
    for k, (text, lang, h, base) in facts.items():
        n, ref = refs.get(lang, (0, None))
        a = distance(h[0], ref[0]) if n >= D.LEAST_TEXTS and len(text) >= D.LEAST_CHARS else None
        b = distance(h[1], ref[1]) if n >= D.LEAST_TEXTS and base[0] >= D.LEAST_WORDS else None
        assert got[k][0] == (a if a is None else pytest.approx(a, abs=1e-9)) and got[k][1] == (b if b is None else pytest.approx(b, abs=1e-9)), k
        rejected = a is not None and a > D.CHAR_BOUND + D.CHAR_SLACK / math.sqrt(len(text)) or b is not None and b > D.WORD_BOUND + D.WORD_SLACK / math.sqrt(base[0])
        assert got[k][2] == (not base[5] and not rejected), k


def test_many_languages_are_not_broadcast(spark, docs, monkeypatch):
    from tessera.llm import divergence as D

    few = {tuple(r) for r in D.judged(docs, carry=["doc_id"]).select("doc_id", "__tessera_kept").collect()}
    monkeypatch.setattr(D, "BROADCAST_LANGUAGES", 0)
    assert {tuple(r) for r in D.judged(docs, carry=["doc_id"]).select("doc_id", "__tessera_kept").collect()} == few


def brute_repeats(corpus, window=20):
    seen, out = set(), {}
    for doc_id, text, *_ in sorted(corpus, key=lambda r: r[0]):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        out[doc_id] = (len(words), sum(gone), sha(b" ".join(w for w, g in zip(words, gone) if not g)))
    return out


@pytest.mark.parametrize("shard", [250_000, 60])
def test_repeats_match_brute_force(spark, tables, corpus, monkeypatch, shard):
    monkeypatch.setattr("tessera.llm.substring_dedup.SHARD_WORDS", shard)
    got = {r[0]: r[1:] for r in rows_of(run(spark, tables, "op2_fm_dedup"), "doc_id", "n_words", "n_removed", "kept_sha256")}
    assert got == brute_repeats(corpus)
    assert sum(v[1] > 0 for v in got.values()) > 8


def test_repeats_know_rows_by_id_and_text(spark):
    """Null ids and ids shared by different long texts: each row loses only its own repeats."""
    from tessera.llm.substring_dedup import remove_repeats

    words = lambda a, n: " ".join(f"w{k}" for k in range(a, a + n))
    twice = words(0, 30) + " x " + words(0, 30)
    rows = [(None, twice), (None, "short"), (None, words(9000, 50)), (7, words(1000, 400)), (7, words(2000, 60) + " y " + words(2000, 60)), (7, words(1000, 400)), (8, words(3000, 30) + " " + words(1100, 25))]
    got = sorted(r[0] for r in remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).select("text").collect())
    assert got == sorted([words(0, 30) + " x", "short", words(9000, 50), words(1000, 400), words(2000, 60) + " y", words(1000, 400), words(3000, 30)])


def test_repeats_of_one_passage_in_many_documents(spark, monkeypatch):
    """No shard outgrows its size, whatever surrounds a passage that very many documents hold, and copies of one document are dealt out."""
    import random

    from tessera.llm import substring_dedup as S

    draw = random.Random(3)
    passage = " ".join(f"p{k}" for k in range(30))
    free = lambda n: " ".join(f"f{draw.randrange(10**7)}" for _ in range(n))
    rows = [(k, f"{free(25)} {passage} {free(25)}") for k in range(3000)] + [(k, passage + " " + passage) for k in range(5000, 5600)]
    monkeypatch.setattr(S, "SHARD_WORDS", 20_000)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    docs = S.identified(df).select(F.col("__tessera_k").alias("k"), F.col("__tessera_h").alias("h"), "text")
    loads = S.shards_of(docs).groupBy("shard").agg(F.sum(F.size(F.split(F.col("words").cast("string"), " ")))).collect()
    assert len(loads) > 3 and max(r[1] for r in loads) < 2 * 20_000
    out = dict(rows_of(S.remove_repeats(df), "doc_id", "text"))
    assert {k: sha(t) for k, t in out.items()} == {k: v[2] for k, v in brute_repeats(rows).items()}


def test_fm_index_locates_and_compares_words():
    from tessera.llm.fm_index import FMIndex

    draw = np.random.default_rng(8)
    text = np.concatenate([np.append(p, 0) for p in [draw.integers(1, 4, 300), np.tile([1, 2, 3], 60), np.full(90, 2)]])
    index = FMIndex(text, 20)
    n = len(text)
    suffixes = sorted(range(n), key=lambda k: (text[k : k + 32].tolist(), k))
    assert index.locate(np.arange(n)).tolist() == suffixes


def test_fm_index_matching_statistics():
    from tessera.llm.fm_index import FMIndex

    draw = np.random.default_rng(3)
    for size in (3, 12):
        parts = [draw.integers(1, size, draw.integers(5, 60)) for _ in range(6)]
        text = np.concatenate([np.append(p, 0) for p in parts])
        index = FMIndex(text, 7)
        joined = " " + " ".join(map(str, text)) + " "
        queries_ = [draw.integers(0, size + 2, 40) for _ in range(5)]
        flat = np.concatenate(queries_)
        known = np.where(flat < index.size, flat, 0)
        ends = np.cumsum([len(q) for q in queries_])
        length, low, high = index.matching_statistics(known, ends - 40, ends)
        for i, (start, end) in enumerate(zip(ends - 40, ends)):
            for at in range(start, end):
                best = 0
                while best < 7 and at + best < end and known[at + best] and f" {' '.join(map(str, flat[at : at + best + 1]))} " in joined:
                    best += 1
                assert length[at] == best
                if best:
                    assert high[at] - low[at] == index.count(flat[at : at + best])


def test_wavelet_matrix_counts_in_digits():
    """Ranks and symbols are exact at every size, in a step for four bits of a symbol, not for one."""
    from tessera.llm.fm_index import WaveletMatrix

    draw = np.random.default_rng(6)
    for n, size in ((1, 1), (31, 2), (32, 16), (64, 17), (500, 300), (1000, 70_000)):
        symbols = draw.integers(0, size, n)
        matrix = WaveletMatrix(symbols, size)
        assert len(matrix.levels) == max(1, -(-int(size - 1).bit_length() // 4))
        found, before = matrix.access(np.arange(n))
        assert found.tolist() == symbols.tolist()
        assert before.tolist() == [int((symbols[:k] == s).sum()) for k, s in enumerate(symbols)]
        for at in (0, n // 2, n):
            asked = draw.integers(0, size, 40)
            assert matrix.rank(asked, np.full(40, at)).tolist() == [int((symbols[:at] == s).sum()) for s in asked]


def test_index_goes_with_its_shard(monkeypatch):
    """A worker that searches shard after shard keeps no index of an earlier one."""
    import gc
    import weakref

    import pyarrow as pa

    from tessera.llm import substring_dedup as S

    made = []

    class Watched(S.FMIndex):
        def __init__(self, *args):
            super().__init__(*args)
            made.append(weakref.ref(self))

    monkeypatch.setattr(S, "FMIndex", Watched)
    words = " ".join(f"w{k}" for k in range(30)).encode()
    shard = pa.table({"first": [True, False], "k": [1, 2], "h": [5, 6], "start": pa.array([0, 4], pa.int32()), "words": pa.array([words, words], pa.binary())})
    assert S.shard_spans(shard).to_pylist() == [{"k": 2, "h": 6, "start": 4, "words": 30}]
    gc.collect()
    assert len(made) == 1 and made[0]() is None


def test_segments_are_cut_many_documents_at_a_time():
    """Segments of many documents leave in one batch; what is streamed and in the index of one shard goes there once, as a first one."""
    import pyarrow as pa

    from tessera.llm import substring_dedup as S

    class Docs:  # takes the function that the tasks run
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    segment = pa.struct([("shard", pa.int32()), ("start", pa.int32()), ("words", pa.int32()), ("first", pa.bool_()), ("gram", pa.int64()), ("salts", pa.int32())])
    texts = ["  a\tb  c\n", None, "d é\x0bf", "g"]
    wanted = [[(3, 1, 2, False, None, None), (3, 1, 2, True, None, None), (4, 0, 1, False, None, None)], [], [(-1, 0, 3, True, 77, 2), (0, 0, 3, False, None, None)], []]
    lists = pa.array([[dict(zip([f.name for f in segment], x, strict=True)) for x in w] for w in wanted], pa.list_(segment))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array([5, 6, 7, 8]), pa.array(texts), lists], names=["k", "h", "text", "wanted"])
    out = list(S._texts(Docs())(iter([batch])))
    assert len(out) == 1
    rows = sorted(tuple(r[c] for c in ("k", "h", "shard", "first", "start", "words", "gram", "salts")) for r in out[0].to_pylist())
    assert rows == [(1, 5, 3, True, 1, b"b c", None, None), (1, 5, 4, False, 0, b"a", None, None), (3, 7, -1, True, 0, "d é f".encode(), 77, 2), (3, 7, 0, False, 0, "d é f".encode(), None, None)]
    # A batch that is a slice of another has its own rows.
    assert [r["words"] for o in S._texts(Docs())(iter([batch.slice(2)])) for r in o.to_pylist()] == ["d é f".encode()] * 2


def test_token_table(spark, tables, corpus):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    start, expected = 0, {}
    for doc_id, text, *_ in sorted(corpus, key=lambda r: r[0]):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        expected[doc_id] = (start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
        start += len(ids)
    got = {r[0]: r[1:] for r in rows_of(run(spark, tables, "op3_token_table"), "doc_id", "start", "n_tokens", "ids_crc32")}
    assert got == expected


def test_plain_words_are_encoded_as_the_library_does():
    """Every character of the short way, alone, inside a word and before each mark; special tokens are found as the library finds them."""
    import string

    from tokenizers import Tokenizer

    from tessera.llm.tokens import _SIMPLE, WORD_BPE, encoder

    t, enc = Tokenizer.from_file(WORD_BPE), encoder(WORD_BPE)
    letters = [chr(k) for k in range(0x250) if _SIMPLE(chr(k))]
    words = [w for c in letters for w in (c, f"x{c}y", f"{c}{c.upper()}s", f"the{c}.")] + [f"Word{m}{n}" for m in string.punctuation for n in ["", *string.punctuation]]
    words += ["<|endoftext|>", "a<|endoftext|>b", "<|startoftext|>.", "<|endoftext|", "x" * 5000, "e\u0301t\u00e9", "don't", "3rd", "½", "\u00a0x", "İi"]
    for w in words:
        assert np.frombuffer(enc.encode([w.encode()])[0], "<u4").tolist() == t.encode(w, add_special_tokens=False).ids, w
    text = " one <|endoftext|>two\nthree<|startoftext|> four "
    assert np.frombuffer(enc.encode([text.encode()])[0], "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
    assert max(map(len, enc.words)) <= 64


def test_token_table_selective_reads(spark, docs, tmp_path):
    from tessera.llm.tokens import read_tokens, write_tokens

    write_tokens(docs, tmp_path.as_uri() + "/t")
    some = read_tokens(spark, tmp_path.as_uri() + "/t", 10, 12, ("doc_id", "n_tokens"))
    assert sorted(r[0] for r in some.collect()) == [10, 11, 12]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "tokens:array" not in plan and "GreaterThanOrEqual(doc_id,10)" in plan


def test_language_model(spark, tables, corpus):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {r[0]: [*(r[1] or "").translate(low).encode().split(), None] for r in corpus}
    held = {k: zlib.crc32(str(k).encode()) % 10 == 0 for k in tokens}
    counts = collections.Counter(w for k, t in tokens.items() if not held[k] for w in t)
    n, v = sum(counts.values()), len(counts)
    better = 0
    for doc_id, out, n_tokens, n_known, total, base, score in rows_of(run(spark, tables, "op4_gru_scores"), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"):
        t = tokens[doc_id]
        assert (out, n_tokens, n_known, total) == (held[doc_id], len(t), sum(counts[w] > 0 for w in t), n)
        assert base == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), abs=1e-6)
        better += math.isfinite(score) and score < 0
    assert better == len(tokens)


def test_gru_gradients_and_carried_state():
    from tessera.llm import gru

    draw = np.random.default_rng(0)
    counts = np.sort(draw.integers(1, 100, 20))[::-1]
    borders = gru.class_borders(counts, 4)
    w = gru.fresh(counts, borders, hidden=5)
    ids, targets = draw.integers(0, 20, (4, 3)), draw.integers(0, 20, (4, 3))
    h = draw.standard_normal((3, 5)).astype(np.float32)
    loss = lambda: gru.window_gradient(w, borders, ids, targets, np.ones((4, 3), bool), h)[2] / 12
    gradient = gru.window_gradient(w, borders, ids, targets, np.ones((4, 3), bool), h)[0]
    for name in gru.NAMES:
        at = (int(ids[1, 1]), 2) if name == "into" else tuple(int(draw.integers(0, s)) for s in w[name].shape)
        old, step = w[name][at], np.float32(1e-2)
        w[name][at] = old + step
        up = loss()
        w[name][at] = old - step
        down = loss()
        w[name][at] = old
        assert (up - down) / (2 * step) == pytest.approx(gradient[name][at], abs=2e-3), name
    text = draw.integers(1, 20, 50)
    one = gru.document_scores(w, borders, np.append(text, 0), np.asarray([0, 51]))
    two = gru.document_scores(w, borders, np.concatenate([np.append(text, 0), np.append(text[:7], 0)]), np.asarray([0, 51, 59]), steps=1)
    assert one == pytest.approx(two[:51], abs=1e-5)
    assert one[:7] == pytest.approx(two[51:58], abs=1e-5)


def test_the_language_model_learns_more_than_counts():
    """Documents that walk round a ring of words: counts know nothing of the next one, a carried state does."""
    from tessera.llm import gru

    draw = np.random.default_rng(4)
    ring = np.arange(2, 22)

    def walk(n):
        at = int(draw.integers(20))
        return np.append(ring[(at + np.arange(n)) % 20], gru.END)

    train, held = [walk(60) for _ in range(400)], [walk(60) for _ in range(20)]
    counts = np.bincount(np.concatenate(train), minlength=22).astype(float) + 1
    borders = gru.class_borders(counts, 4)
    trainer = gru.Trainer(gru.fresh(counts, borders), borders)
    for _ in range(4):
        trainer.learn(np.concatenate(train), lanes=8)
    ids = np.concatenate(held)
    starts = np.concatenate([[0], np.cumsum([len(x) for x in held])])
    scores = gru.document_scores(trainer.w, borders, ids, starts)
    base = np.log(counts / counts.sum())[ids]
    assert scores.mean() > base.mean() + 0.5
    # One document alone, word by word, has the same likelihood.
    h, last, plain = np.zeros((1, trainer.w["inner"].shape[0]), np.float32), np.asarray([gru.END]), []
    for word in held[0]:
        h = gru.step(trainer.w, trainer.w["into"][last], h)[-1]
        plain.append(float(gru.log_likelihood(trainer.w, borders, h, np.asarray([word]))[0]))
        last = np.asarray([word])
    assert scores[: len(plain)] == pytest.approx(plain, abs=1e-5)


def test_dual_coordinate_descent_finds_the_optimum():
    from tessera.llm import nbsvm as N

    draw = np.random.default_rng(2)
    labels = draw.integers(0, 2, 60)
    some = draw.random((60, 200)) < np.where(labels[:, None] == 1, np.linspace(0.1, 0.4, 200), np.linspace(0.4, 0.1, 200))
    rows = np.zeros((60, N.WIDTH), bool)
    rows[:, :200] = some
    bits = np.packbits(rows, axis=1)
    scale = N.log_count_ratios(bits, labels)
    x = rows[:, :200] * scale[:200]
    x = np.hstack([x / np.linalg.norm(x, axis=1, keepdims=True), np.ones((60, 1))])
    y = np.where(labels == 1, 1.0, -1.0)
    loss = lambda w: 0.5 * w @ w + N.COST * np.maximum(0, 1 - y * (x @ w)).sum()
    found = N.dual_coordinate_descent(bits, labels, scale, epochs=2000)
    own = np.append(found[:200], found[-1])
    assert not found[200:-1].any()
    best, w = np.inf, np.zeros(201)
    for t in range(1, 20_001):  # subgradient descent
        w = w - (w - N.COST * (y * (1 - y * (x @ w) > 0)) @ x) / t
        best = min(best, loss(w))
    assert loss(own) <= best + 1e-3 * best
    assert loss(np.append(*(lambda v: (v[:200], v[-1]))(N.dual_coordinate_descent(bits, labels, scale)))) <= 1.05 * loss(own)


def test_quality_classifier(spark, tables, corpus):
    got = {r[0]: r[1:] for r in rows_of(run(spark, tables, "op5_quality_classifier"), "doc_id", "held_out", "score", "predicted")}
    assert set(got) == {r[0] for r in corpus}
    assert all(0 <= s <= 1 and p == int(s >= 0.3) and h == (zlib.crc32(str(k).encode()) % 5 == 0) for k, (h, s, p) in got.items())
    texts = {r[0]: r[1] for r in corpus}
    assert np.mean([got[k][1] for k in range(60)]) > got[next(k for k, t in texts.items() if t and "***" in t)][1]


def test_quality_classifier_without_labels(spark, docs):
    from tessera.llm.nbsvm import scored, train

    model = train(docs, spark.createDataFrame([], "doc_id bigint, quality int"))
    assert {round(r[0], 6) for r in rows_of(scored(docs, model), "score")} == {0.5}
    one = train(docs, spark.createDataFrame([(1, 1), (2, 1)], "doc_id bigint, quality int"))
    assert {round(r[0], 6) for r in rows_of(scored(docs, one), "score")} == {0.75}


def test_byte_bpe(spark, tables, corpus):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    t = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r[0]: r[1:] for r in rows_of(run(spark, tables, "op6_byte_bpe"), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")}
    for doc_id, text, *_ in corpus:
        ids = t.encode_ordinary(text or "")
        assert got[doc_id] == (len(ids), sha(",".join(map(str, ids))), sha(text or "")), doc_id


def test_every_piece_goes_through_determinised_steps(corpus):
    """Pieces that are not remembered are read byte by byte through steps; tokens come out before the end."""
    from tessera.llm.byte_bpe import Encoder

    enc = Encoder()
    pieces = {p for r in corpus for p in enc.cut(r[1] or "")}
    for r in corpus:
        enc.encode(r[1] or "")
    read = enc.transducer.bytes_read
    assert read >= sum(len(p.encode()) for p in pieces) and 0 < enc.transducer.steps_built < read
    long = "deterministically" * 500
    parts = list(enc.transducer.stream(long.encode()))
    assert tuple(t for p in parts for t in p) == enc.transducer.encode(long.encode()) and enc.transducer.lookahead < 64


def test_transducer_against_merging():
    import random

    from tessera.llm.byte_bpe import RANKS, Transducer, Utf8Stream, merge, read_ranks

    ranks = read_ranks(RANKS)
    t = Transducer(ranks, kept_states=50)
    draw = random.Random(1)
    for _ in range(1500):
        piece = "".join(draw.choice("abcdeing thé你 ..") for _ in range(draw.randint(1, 14))).encode()
        assert t.encode(piece) == merge(piece, ranks)
    for _ in range(500):
        data = bytes(draw.choice([draw.randrange(256), 0xE0, 0xED, 0xF0, 0xC3, 0x41]) for _ in range(draw.randint(0, 9)))
        s = Utf8Stream()
        assert "".join(s.feed(data[k : k + 1]) for k in range(len(data))) + s.finish() == data.decode("utf-8", "replace")


def test_transport_stream(spark, tables, corpus):
    got = {r[0]: r[1:] for r in rows_of(run(spark, tables, "op7_transport_stream"), "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_sha256", "feature")}
    for doc_id, text, *_ in corpus:
        raw = (text or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        assert got[doc_id][:4] == (len(raw), len(payload), sha(payload), zlib.crc32(payload[-16:]))
        assert "continuity_errors=0;table_errors=0;lost_bytes=0" in got[doc_id][5]
    same = collections.defaultdict(set)
    for doc_id, text, *_ in corpus:
        same[text or ""].add(got[doc_id])
    assert all(len(v) == 1 for v in same.values())


def test_damaged_transport_streams():
    from tessera.llm.transport_stream import PACKET, read_stream, write_stream

    data = write_stream(bytes(range(256)) * 200)
    whole = read_stream(data)
    assert whole.payload() == bytes(range(256)) * 200 and whole.continuity_errors == 0 and [u[1] for u in whole.units][:3] == [0, 3600, 7200] and whole.units[8][3]
    assert read_stream(data[: 30 * PACKET] + data[31 * PACKET :]).continuity_errors == 1
    twice = read_stream(data[: 31 * PACKET] + data[30 * PACKET :])
    assert twice.payload() == whole.payload() and twice.continuity_errors == 0
    assert read_stream(b"junk" + data).lost_bytes == 4
    broken = bytearray(data)
    broken[10] ^= 1
    assert read_stream(bytes(broken)).table_errors == 1
    assert read_stream(b"").packets == 0


def luhn(digits):
    values = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(v - 9 * (v > 9) for v in values) % 10 == 0


PERSONAL = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for order, (kind, pattern) in enumerate(PERSONAL.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((m.start(), order, m.end(), kind))
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(out)]


def test_personal_data(spark, tables, corpus):
    got = {r[0]: r[1:] for r in rows_of(run(spark, tables, "op8_personal_data"), "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")}
    for doc_id, text, *_ in corpus:
        base = base_spans(text)
        kinds = collections.Counter(x.split(":")[0] for x in base)
        assert got[doc_id][:5] == (*(kinds[k] for k in PERSONAL), sha(",".join(base))), doc_id
        assert set(base) <= set(filter(None, got[doc_id][5].split(",")))
    assert any(v[5] for v in got.values()) and not got[0][5]


def test_personal_data_in_a_text_full_of_numbers(spark):
    """A megabyte of numbers and keys takes time in proportion; spans and redaction are those of a plain version."""
    import time

    from tessera.llm.personal import all_spans, found_spans, redact

    part = "call 555-123-4567 or +44 20 7946 0958, 10.0.0.7 key=ab12cd34ef56ab12cd34ef56 4111 1111 1111 1111 a@b.org é "
    rows = [(1, part * 3), (2, part * 1_500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    begun = time.time()
    spans = {r["doc_id"]: [(x["start"], x["end"], x["kind"]) for x in r["__tessera_spans"]] for r in all_spans(found_spans(df)).collect()}
    assert time.time() - begun < 60
    base = base_spans(part)
    n = len(part)
    assert len(spans[2]) * 3 == len(spans[1]) * 1_500
    assert {(s % n, e % n, k) for s, e, k in spans[2]} == {(s % n, e % n, k) for s, e, k in spans[1]}
    assert {f"{['email', 'ip', 'card', 'phone', 'secret'][k]}:{s}:{e}" for s, e, k in spans[1] if s < n} >= set(base)
    begun = time.time()
    out = {r["doc_id"]: r["text"] for r in redact(df).collect()}
    assert time.time() - begun < 60
    for doc_id, text in rows:
        plain, at = [], 0
        for s, e, k in sorted(spans[doc_id]):
            if s >= at:
                plain += [text[at:s], f"<{['email', 'ip', 'card', 'phone', 'secret'][k]}>"]
            at = max(at, e)
        assert out[doc_id] == "".join(plain) + text[at:]


def test_running_joins(spark):
    from tessera.llm.personal import running

    import random

    draw = random.Random(2)
    for n in (0, 1, 23, 24, 25, 600, 15_000):
        values = [draw.randrange(100) for _ in range(n)]
        got = spark.createDataFrame([(values,)], "v array<bigint>").select(running(F.col("v"), lambda a, b: a + b, 0), running(F.col("v"), F.greatest, -1)).first()
        total, most = 0, -1
        for k, v in enumerate(values):
            assert (got[0][k], got[1][k]) == (total, most)
            total, most = total + v, max(most, v)
        assert len(got[0]) == n


@pytest.mark.parametrize("text", ["a@b.c@d.e x@y.com_foo@bar.com", "1.2.3.4.5.6.7.8 0001.2.3.255 1.2.3", "+1+1+1 (22) 333 4444 5555+", "4111-1111-1111-1111 4111 1111 1111 1112 4 1 1 1", "1" * 30_000, "a" * 20_000 + "@", "+" + "1" * 9, "ü 10.0.0.1 😀 j@k.lm"])
def test_personal_patterns_match_plain_ones(spark, text):
    from tessera.llm.personal import KINDS, found_spans

    df = spark.createDataFrame([(text,)], "text string")
    spans = found_spans(df, carry=[]).first()[0]
    assert [f"{KINDS[s['kind']]}:{s['start']}:{s['end']}" for s in sorted(spans, key=lambda s: (s["start"], s["kind"]))] == base_spans(text)


def test_redaction(spark, docs, corpus):
    from tessera.llm.personal import redact

    out = {r["doc_id"]: r for r in redact(docs).collect()}
    assert len(out) == len(corpus)
    marked = next(r for r in out.values() if r["text"] and "<email>" in r["text"])
    assert "joe.blow" not in marked["text"] and "<phone>" in marked["text"] and "<card>" in marked["text"] and "<ip>" in marked["text"] and marked["n_chars"] == len(marked["text"])
    texts = {r[0]: r[1] for r in corpus}
    assert all(out[k]["text"] == texts[k] for k in range(60))


def shingles(text, k):
    w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute_groups(corpus, k, percent):
    sets = {r[0]: shingles(r[1], k) for r in corpus}
    ids, group = sorted(sets), {i: i for i in sets}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                group[y] = x
    return {i: (len(sets[i]), top(i), top(i) == i) for i in ids}


def test_near_duplicates(spark, tables, corpus):
    got = {r[0]: r[1:] for r in rows_of(run(spark, tables, "op9_minmax_dedup"), "doc_id", "n_shingles", "component_id", "kept")}
    assert got == brute_groups(corpus, 4, 80)
    assert sum(not v[2] for v in got.values()) >= 6


def test_near_duplicates_in_one_large_family(spark, monkeypatch):
    """A chain of texts each a little further from the first: only some are linked to the least member of a bucket."""
    import random

    from tessera.llm import minmax

    draw = random.Random(2)
    words = [f"w{draw.randrange(10**6)}" for _ in range(120)]
    rows = []
    for k in range(60):
        for _ in range(2):
            words[draw.randrange(120)] = f"w{draw.randrange(10**6)}"
        rows.append((k, " ".join(words), "en", "s", 0))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for block in (150_000, 300):
        monkeypatch.setattr(minmax, "BLOCK", block)
        got = {r[0]: r[1:] for r in rows_of(minmax.near_duplicates(df, 4, 80), "doc_id", "n_shingles", "component_id", "kept")}
        assert got == brute_groups(rows, 4, 80)


def test_components_of_a_path(spark):
    from tessera.llm.components import components

    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 99), (None, 3), (7, 7)], "a bigint, b bigint")
    got = dict(rows_of(components(links), "node", "component"))
    assert got == {**dict.fromkeys(range(41), 0), 99: 99, 100: 99}


def test_packing(spark, tables, corpus):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    expected = {}
    for doc_id, text, *_ in corpus:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            expected[doc_id, piece] = (at, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes()))
    out = rows_of(run(spark, tables, "op10_genetic_packing"), "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    assert {r[:2]: r[2:5] for r in out} == expected and len(out) == len(expected)
    bins = collections.defaultdict(list)
    for r in out:
        bins[r[5]].append((r[6], r[3]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(r[3] for r in out) // 2048) + 2


def test_packed_ids(spark, docs):
    from tessera.llm.packing import cut_pieces, pack_pieces, packed_ids

    placed = pack_pieces(cut_pieces(docs))
    sequences = packed_ids(docs, placed).select(F.size("tokens")).collect()
    assert max(r[0] for r in sequences) <= 2048 and sum(r[0] for r in sequences) == placed.agg(F.sum("length")).first()[0]


def test_crossover_keeps_every_piece():
    from tessera.llm.packing import Packing, best_fit, crossover, evolve

    draw = np.random.default_rng(1)
    sizes = draw.integers(1, 1500, 300)
    some = [Packing(best_fit(sizes, draw.permutation(300), np.full(300, -1), [], 2048), sizes) for _ in range(2)]
    child = crossover(*some, sizes, 2048, np.random.Generator(np.random.PCG64(2)))
    assert child.fill.sum() == sizes.sum() and child.fill.max() <= 2048 and (child.bins >= 0).all()
    best = evolve(sizes, [], 3)[0]
    assert len(np.unique(best)) <= min(len(p.fill) for p in some)


@pytest.mark.parametrize(("low", "high", "n"), [(300, 900, 2000), (400, 1100, 2000)])
def test_evolution_beats_best_fit_decreasing(low, high, n):
    """Where sorted pieces leave gaps, injected full bins close them."""
    from tessera.llm.packing import Packing, best_fit, evolve

    sizes = np.random.default_rng(4).integers(low, high, n)
    plain = Packing(best_fit(sizes, np.argsort(-sizes, kind="stable"), np.full(n, -1), [], 2048), sizes)
    best = evolve(sizes, evolve(sizes, [], 1, children=30), 2, children=30)[0]
    fill = np.bincount(best, weights=sizes)
    assert len(fill) < len(plain.fill) and fill.max() <= 2048 and fill.sum() == sizes.sum()


def test_words_are_told_apart_in_lower_case_only_where_ids_stay():
    """A word's forms with capitals were kept and encoded one by one; marks that join what is before them, and special tokens, forbid lower case."""
    from tokenizers import Tokenizer

    from tessera.llm.tokens import WORD_BPE, WordEncoder

    enc, whole = WordEncoder(WORD_BPE), Tokenizer.from_file(WORD_BPE)
    enc.encode([b"And and AND aNd and"])
    assert len(enc.words) == 1
    texts = ["H̱ ẖ T̈ W̊ J̌ İ é É", "<|STARTOFTEXT|> And", "<|startoftext|>And <|EndOfText|>", "Ünter ÄÖÜ, ǅ ǈX ȺB É. Ça 3.14A Don'T IT'S", "ΑΣ Σ ΟΔΟΣ ПРИВЕТ", "İI ıI K Å ſS ẞ", "A B C\u0085D \x1cE", "ɐⱯ ɏZ ʰA ʰB", ""]
    ids = [np.frombuffer(x, "<u4").tolist() for x in enc.encode([t.encode() for t in texts])]
    assert ids == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert enc._lowered(b"A\xc3\x89") == b"a\xc3\x89" and enc._lowered("H̱".encode()) == "H̱".encode()


def test_tables_kept_for_removal_leave_no_shuffle_files(spark):
    """Shuffle files of what was already written stayed until the driver collected its garbage; the setting is put back."""
    from tessera.llm import shared

    setting, asked = spark.conf.get(shared._CLEANED), []
    df = spark.range(20_000).groupBy((F.col("id") % 5_000).alias("x")).count()

    class Seen:
        sparkSession = spark

        def __getattr__(self, name):
            asked.append(spark.conf.get(shared._CLEANED))
            return getattr(df, name)

    assert shared.stored(Seen(), "test", cleaned=True).count() == 5_000 and "true" in asked
    assert spark.conf.get(shared._CLEANED) == setting and df.where("count = 4").count() == 5_000
