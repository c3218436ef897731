"""Small fixtures with nulls, empty and repeated rows, against brute force or the public library."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chainspark.llm import ann, bpe, brown, components, minhash, mixing, sharding, suffixes, superkmers, topk, toxicity, wordrepeats

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, root string, rank string"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 400, n))
    shared, near = word(60), word(120)
    texts = [None, "", "  \n", "one two", word(200), shared + " " + word(50), word(30) + "\n" + shared, near, near.replace("w1 ", "w2 "), near, "a " * 90, "é" * 900, "x y " + word(20)]
    out = [(i, t, "en", ["b", None, "a"][i % 3], 0, "r", "k") for i, t in enumerate(texts)]
    return out + [out[4], (None, texts[5], "en", None, 0, "r", "k"), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def smallest(doc_id):
    return -(1 << 63) if doc_id is None else doc_id


def total(cover):
    return Counter({(r.did, r.rid): len({u for s in r.cover for u in range(s.s, s.e)}) for r in cover.collect()})


def test_words_removed_match_brute_force(docs, empty, rows):
    for largest in (20_000, 1):
        got = total(wordrepeats.repeated_words(docs, largest=largest))
        first, want = {}, Counter()
        texts = sorted({(smallest(r[0]), r[1] or "") for r in rows})
        for d, t in texts:
            w = t.encode().split()
            for p in range(len(w) - 19):
                k = tuple(w[p : p + 20])
                first[k] = min(first.get(k, (d, p)), (d, p))
        for d, t in texts:
            w = t.encode().split()
            gone = {q for p in range(len(w) - 19) if first[tuple(w[p : p + 20])] != (d, p) for q in range(p, p + 20)}
            want[d] += len(gone)
        by_id = Counter()
        for (d, _), n in got.items():
            by_id[d] += n
        assert +by_id == +want
    assert wordrepeats.repeated_words(empty).count() == 0
    cleaned = wordrepeats.without_repeats(docs)
    assert cleaned.columns == docs.columns and cleaned.count() == docs.count()


def test_bytes_removed_match_brute_force(docs, empty, rows):
    counts = Counter(b[p : p + 400] for r in rows for b in [(r[1] or "").encode()] for p in range(len(b) - 399))
    want = Counter()
    for d, t in {(smallest(r[0]), r[1] or "") for r in rows}:
        b = t.encode()
        want[d] += len({q for p in range(len(b) - 399) if counts[b[p : p + 400]] > 1 for q in range(p, p + 400)})
    for largest in (4_000, 1):
        by_id = Counter()
        for (d, _), n in total(suffixes.repeated_bytes(docs, largest=largest)).items():
            by_id[d] += n
        assert +by_id == +want
    assert suffixes.repeated_bytes(empty).count() == 0


def test_hot_minimisers_are_dealt_and_cut_again(spark, monkeypatch):
    """A passage that most texts hold, with different words around it, in copies too: the same answer in whatever way it is found."""
    rng = np.random.default_rng(8)
    word = lambda n: " ".join(f"v{x}" for x in rng.integers(0, 500, n))
    common = word(30)
    texts = [f"{word(25)} {common} {word(25)}" for _ in range(30)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:5] * 4)], "doc_id bigint, text string")
    for repeats in (suffixes.repeated_bytes, wordrepeats.repeated_words):
        monkeypatch.setattr(superkmers, "FLOOR", 1_000)
        plain = total(repeats(docs, window=20, gram=6))
        assert len(plain) >= 49
        monkeypatch.setattr(superkmers, "FLOOR", 1)
        for largest in (20_000, 3):
            assert total(repeats(docs, window=20, gram=6, largest=largest)) == plain


def test_maximal_repeats():
    text = np.frombuffer(b"banana", np.uint8).astype(np.int64)
    starts = np.arange(6)
    order, common = suffixes.suffix_array(text, starts, 6 - starts, 6)
    assert order.tolist() == [5, 3, 1, 0, 4, 2] and common.tolist() == [0, 1, 3, 0, 0, 2]
    before = np.where(order > 0, text[order - 1], 0)
    assert sorted(suffixes.maximal_repeats(common, before, 1)) == [(1, 0, 2), (3, 1, 2)]


def test_near_classes(docs, empty):
    got = {}
    for r in minhash.near_classes(docs).collect():
        got.setdefault(r.root, set()).add(r.did)
    classes = sorted(map(sorted, (x - {None} for x in got.values())))
    assert [0, 1] in classes and [4] in classes and any({7, 9} <= set(c) for c in classes)
    assert minhash.one_of_each(docs).count() == len(got)
    assert minhash.near_classes(empty).count() == 0


def test_near_classes_match_brute_force(spark):
    """All pairs by exact weighted Jaccard similarity, over texts that differ in a few words each."""
    rng = np.random.default_rng(12)
    texts = []
    for _ in range(6):
        base = [f"w{x}" for x in rng.integers(0, 900, 150)]
        for _ in range(12):
            some = list(base)
            for at in rng.integers(0, 150, rng.integers(0, 5)):
                some[at] = f"n{rng.integers(0, 900)}"
            texts.append(" ".join(some))
    texts += ["one two", "one two three", "", "  ", texts[0]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    weights = minhash.word_weights(docs)
    keys, mass, cuts = weights.shingles(pa.array(texts))
    held = [dict(zip(keys[a:b].tolist(), mass[a:b].tolist())) for a, b in zip(cuts, cuts[1:])]
    root = list(range(len(texts)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(texts)):
        for j in range(i):
            shared = sum(min(w, held[j].get(k, 0)) for k, w in held[i].items())
            if texts[i] == texts[j] or (shared and shared >= 0.8 * (sum(held[i].values()) + sum(held[j].values()) - shared)):
                root[find(max(i, j, key=find))] = find(min(i, j, key=find))
    want, got = {}, {}
    for i in range(len(texts)):
        want.setdefault(find(i), set()).add(i)
    for r in minhash.near_classes(docs).collect():
        got.setdefault(r.root, set()).add(r.did)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_links_join_classes(spark):
    pairs = lambda rows: spark.createDataFrame(rows, "a string, b string")
    roots = components.components(pairs([("b", "a"), ("c", "b"), ("x", "y")]))
    more = components.joined(roots, pairs([("y", "c"), ("m", "n"), ("a", "b")]))
    assert {r.node: r.root for r in more.collect()} == {"a": "a", "b": "a", "c": "a", "x": "a", "y": "a", "m": "m", "n": "m"}
    assert components.joined(more, pairs([("a", "a")]).limit(0)).count() == 7


def test_tokens_match_library(docs, empty, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs, bpe.public_file()).collect())
    want = []
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want)
    assert bpe.encode_documents(empty, bpe.public_file()).count() == 0
    coded = bpe.encode_documents(docs, bpe.public_file(), decoded="back")
    both = bpe.decode_documents(coded, bpe.public_file()).collect()
    assert sorted(r.text for r in both) == sorted(r.back for r in both) == sorted(r[1] or "" for r in rows)
    special = "a<|endoftext|> b\0c"
    ids = bpe.vocabulary(bpe.public_file())
    assert bpe.decode_ids(library.encode(special).ids, bpe.public_file()) == special and ids.special


def test_shards(docs, empty, rows):
    got = sharding.shard_rows(docs, 3).collect()
    assert len(got) == len(rows)
    for s in range(3):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots))) and abs(len(slots) - len(rows) / 3) < 1
    assert sharding.shard_rows(empty).count() == 0


def test_mix(docs, empty):
    got = mixing.mix_documents(docs, block=8).collect()
    assert len(got) == docs.count() and all(0 <= r.taken <= 2 * r.size for r in got)
    assert mixing.mix_documents(empty).count() == 0 and mixing.mixed_copies(empty).count() == 0
    again = mixing.mix_documents(docs.repartition(5), block=8).collect()
    assert sorted((r.key, r.taken) for r in got) == sorted((r.key, r.taken) for r in again)


def test_each_source_comes_near_its_target(spark):
    sizes = {"a": 9000, "b": 700, "c": 40, "d": 3, None: 2000}
    rows = [(i, " ".join(["w"] * (n // 3)), s) for i, (s, n) in enumerate((s, n) for s, n in sizes.items() for _ in range(3))]
    rows += [(100, None, "e"), (101, " \n", "a"), (102, "", "d")]
    got = mixing.mix_documents(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    taken, target, source = Counter(), {}, {r[0]: r[2] for r in rows}
    for r in got:
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
        assert r.taken <= 2 * r.size
    # Weights 3, 1, 2, 3, 1 in code point order, null last; each target stops at twice its source's size.
    own = {s: 3 * (n // 3) for s, n in sizes.items()} | {"e": 0}
    weight, left, free, want = dict(zip(["a", "b", "c", "d", "e", None], [3, 1, 2, 3, 1, 2])), 1.5 * sum(own.values()), set(own), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * own[s]}
        for s in full or free:
            want[s] = min(2 * own[s], level * weight[s])
        left -= sum(want[s] for s in full)
        free = free - full if full else set()
    assert target == pytest.approx(want)
    assert all(abs(taken[s] - target[s]) <= max(2, 0.02 * target[s]) for s in target)


def test_mixed_copies_without_words_and_with_clashing_names(spark):
    rows = [(1, None, "a", "x", 7), (2, " ", "a", "x", 7), (3, "one two three", "b", "x", 7), (3, "one two three", "b", "x", 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, copies string, mix_copy int")
    got = mixing.mixed_copies(docs).collect()
    assert {tuple(r) for r in got} == {rows[2]} and len(got) in (2, 3, 4)
    assert mixing.mixed_copies(docs.where("doc_id < 3")).count() == 0


def test_vector_searches(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    z = np.floor(64 * np.vstack([x, np.zeros((1, 16))])).astype(int)
    ids = [*range(300), 901]
    got = [tuple(r) for r in topk.top_inner_products(table, k=5, row_block=100).orderBy("query_id", "rank").collect()]
    want = []
    for q in range(0, 300, 20):
        s = sorted((-int(z[q] @ z[j]), ids[j]) for j in range(301) if ids[j] != q)[:5]
        want += [(q, i + 1, d, -v) for i, (v, d) in enumerate(s)]
    assert got == want
    found = {(r.query_id, r.vec_id) for r in ann.nearest(table).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    truth = {(q, int(j)) for q in range(0, 300, 50) for j in [j for j in np.argsort(-(u[q] @ u.T)) if j != q][:5]}
    assert len(found & truth) >= 0.9 * len(truth)
    assert topk.top_inner_products(table.limit(0)).count() == 0 and ann.nearest(table.limit(0)).count() == 0


def test_language_model(docs, empty, rows):
    model, words = brown.fit(docs.select("text"))
    tokens = [[w for w in (r[1] or "").lower().split()] + [None] for r in rows if r[1] is None or " " not in r[1]]
    got = brown.score_texts(docs, model, words).collect()
    assert len(got) == len(rows) and all(np.isfinite(r.score) and r.score <= 0 for r in got)
    assert model.n == sum(r.n_tokens for r in got) and all(r.n_known == r.n_tokens for r in got) and tokens


def test_classes_come_from_all_texts(spark, monkeypatch):
    monkeypatch.setattr(brown, "SEEDS", 40)
    rng = np.random.default_rng(6)
    texts = [(" ".join(f"w{int(x)}" for x in rng.zipf(1.3, 60) % 300),) for _ in range(120)]
    whole = spark.createDataFrame(texts, "text string").coalesce(1)
    model, words = brown.fit(whole)
    cut_up, cut_words = brown.fit(whole.repartition(8))
    cls = {r.h: (r.n, r.cls) for r in words.collect()}
    assert cls == {r.h: (r.n, r.cls) for r in cut_words.collect()} and np.array_equal(model.log_t, cut_up.log_t)
    want = np.zeros((brown.CLASSES + 1, brown.CLASSES + 1))
    codes, hashed, offsets = brown.tokens(pa.array([t for t, in texts]))
    own = np.array([cls[h][1] for h in hashed.tolist()])[codes]
    np.add.at(want, (brown.before(own, offsets, brown.CLASSES), own), 1)
    assert [cls[h][0] for h in hashed.tolist()] == np.bincount(codes).tolist()
    size = np.bincount(own, minlength=brown.CLASSES + 1)
    assert np.allclose(model.log_t, brown.log_transitions(want, (size + 0.5) / (size + 0.5).sum()))


def test_toxicity(spark):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(900):
        words = [f"w{x}" for x in rng.integers(0, 200, 60)]
        bad = i % 4 == 0
        if bad:
            words[10] = words[30] = f"slur{i % 3}"
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame([*rows, (9001, None), (9002, "")], "doc_id bigint, text string")
    table = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, table)
    score = {r.doc_id: r.score for r in toxicity.narrow_scores(docs, model).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(score[i] >= 0.7) == (i % 4 == 0) for i in held]) > 0.95 and 0 <= score[9001] <= 1
    whole = toxicity.score_documents(docs, model, "score")
    assert whole.columns == ["doc_id", "text", "score"] and {r.doc_id: r.score for r in whole.collect()} == score
    none = toxicity.fit(docs.limit(0), table.limit(0))
    assert toxicity.ordinary_documents(docs, none).count() == docs.count()


def test_toxicity_of_a_rare_class(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join([f"w{x}" for x in rng.integers(0, 8000, 60)] + ["slur"] * (i % 50 == 0))) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, int(i % 50 == 0)) for i, _ in rows], "doc_id bigint, toxic int"))
    seen = np.array(sorted({w for i, t in rows if i % 50 == 0 for w in t.split()}))
    toxic = model.words[model.ratios[:, 0] > 0]
    assert len(toxic) and np.isin(toxic, toxicity.hash64(pa.array(seen))).all() and toxicity.hash64(pa.array(["slur"]))[0] in toxic


def test_toxicity_ratios_equal_the_rule(spark):
    """Counts of contexts, discounts and shared backoff against a plain restatement, with and without each fold."""
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 30, 25)) + (" bad" * (i % 4) if i % 3 == 0 else ""), int(i % 3 == 0), i % toxicity.FOLDS) for i in range(120)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int, part int").repartition(5)
    pairs = table.mapInArrow(toxicity.context_folds, "v bigint, w bigint, m0 bigint, m1 bigint").groupBy("v", "w").agg(F.bit_or("m0").alias("m0"), F.bit_or("m1").alias("m1"))
    words, ratios = toxicity.word_ratios(pairs)
    for g in range(toxicity.FOLDS + 1):
        contexts = [{}, {}]
        for _, text, y, part in rows:
            if part != g - 1:
                for v, w in zip(["", *text.split()], text.split()):
                    contexts[y].setdefault(w, set()).add(v)
        k = [{w: len(v) for w, v in c.items()} for c in contexts]
        t = [sum(x.values()) for x in k]
        size = min(t)
        e = [{w: max(0.0, k[c].get(w, 0) * size / t[c] - toxicity.DISCOUNT - toxicity.EXPLAINED * k[1 - c].get(w, 0) * size / t[1 - c]) for w in set(k[0]) | set(k[1])} for c in (0, 1)]
        want = {}
        for w in e[0]:
            pooled = (k[0].get(w, 0) + k[1].get(w, 0)) / sum(t)
            free = [size - sum(e[c].values()) for c in (0, 1)]
            p = [(e[c][w] + free[c] * pooled) / free[c] for c in (0, 1)]
            want[toxicity.hash64(pa.array([w]))[0]] = np.log(p[1]) - np.log(p[0])
        got = dict(zip(words.tolist(), ratios[:, g]))
        assert all(abs(got.get(h, 0.0) - r) < 1e-9 for h, r in want.items()) and any(r > 0.5 for r in want.values())


def test_part_masses_bound_what_texts_share():
    rng = np.random.default_rng(3)
    texts = pa.array([" ".join(f"w{x}" for x in rng.integers(0, 40, n)) for n in (60, 60, 7, 300)])
    keys, weights, offsets = minhash.Weights(np.zeros(0, np.int64), np.zeros(0), 10).shingles(texts)
    mass, parts = minhash.part_masses(keys, weights, offsets)
    held = [dict(zip(keys[a:b].tolist(), weights[a:b].tolist())) for a, b in zip(offsets, offsets[1:])]
    for i in range(4):
        assert abs(mass[i] - sum(held[i].values())) < 1e-3
        for j in range(4):
            shared = sum(min(w, held[j].get(k, 0)) for k, w in held[i].items())
            assert np.minimum(parts[i] * mass[i], parts[j] * mass[j]).sum() / minhash.UNIT >= shared - 1e-3


def test_equal_rows_are_worked_on_once(spark):
    """2,000 rows of one id and text, and null ids with a common text: whole results, without pairs of equal rows."""
    rng = np.random.default_rng(9)
    text = " ".join(f"v{x}" for x in rng.integers(0, 300, 130))
    other = " ".join(f"v{x}" for x in rng.integers(0, 300, 40))
    rows = [(7, text, "en", "a", 0, "r", "k")] * 2000 + [(None, f"{other} {text}", "en", "a", 0, "r", "k")] * 500 + [(8, text[:500], "en", "a", 0, "r", "k"), (9, other, "en", "a", 0, "r", "k")]
    table = spark.createDataFrame(rows, SCHEMA).repartition(7)
    kept = {(r.doc_id, r.text) for r in wordrepeats.without_repeats(table).select("doc_id", "text").collect()}
    assert kept == {(None, f"{other} {text}"), (7, ""), (8, text[:500].split()[-1] if not text[500:501].isspace() and text[499:500] != " " else ""), (9, "")}
    cover = suffixes.repeated_bytes(table)
    n = {r.did: max(s.e for s in r.cover) for r in cover.collect()}
    assert n == {7: len(text), -(1 << 63): len(other) + 1 + len(text), 8: 500}


def test_brown_scores_do_not_depend_on_partitions(spark):
    """All words are counted before seeds are chosen: slices and files change nothing but the last digits."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").repartition(1)
    train = lambda d: d.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 1)
    seen = []
    for parts in (1, 2, 13):
        table = docs.repartition(parts, "doc_id") if parts > 1 else docs
        model, words = brown.fit(train(table))
        seen.append({r.doc_id: r for r in brown.score_texts(table, model, words).collect()})
    first = seen[0]
    for more in seen[1:]:
        assert all(abs(first[k].score - r.score) < 1e-9 * max(1, abs(r.score)) and first[k].n_known == r.n_known for k, r in more.items())
    counts = Counter()
    texts = {r.doc_id: (r.text or "") for r in docs.collect()}
    tokens = {k: [bytes(w).lower() for w in t.encode().split()] + [None] for k, t in texts.items()}
    for k, t in tokens.items():
        if zlib.crc32(str(k).encode()) % 5 != 1:
            counts.update(t)
    total, kinds = sum(counts.values()), len(counts)
    for k, t in tokens.items():
        base = sum(np.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in t)
        assert (first[k].n_tokens, first[k].n_known) == (len(t), sum(counts[w] > 0 for w in t)) and abs(first[k].base_score - base) < 1e-9 * max(1, abs(base))


def test_ties_of_both_searches(spark, monkeypatch):
    """Equal vectors, in buckets that are dealt over parts: the smaller ids come first."""
    monkeypatch.setattr(ann, "ROWS", 40)
    monkeypatch.setattr(ann, "QUERIES", 2)
    rows = [(i, [1.0, 2.0, 0.5] if i % 2 else [1.0, 2.0, 0.25]) for i in range(400)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {}
    for r in ann.nearest(table).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    assert got == {q: dict(enumerate([i for i in range(0, 400, 2) if i != q][:5], 1)) for q in range(0, 400, 50)}
    best = {}
    for r in topk.top_inner_products(table).collect():
        best.setdefault(r.query_id, {})[r.rank] = r.vec_id
    # floor(64 x) of the third component is larger in odd rows, and so is their product with any query
    assert best == {q: dict(enumerate([i for i in range(1, 400, 2)][:20], 1)) for q in range(0, 400, 20)}


def test_very_long_texts(spark):
    """One text of 120,000 words and a short one with a passage of it."""
    rng = np.random.default_rng(12)
    words = [f"x{v}" for v in rng.integers(0, 50_000, 120_000)]
    passage = " ".join(words[70_000:70_100])
    rows = [(1, " ".join(words), "en", "a", 0, "r", "k"), (2, "before it " + passage, "en", "a", 0, "r", "k")]
    table = spark.createDataFrame(rows, SCHEMA)
    assert {r.doc_id: r.text for r in wordrepeats.without_repeats(table).collect()}[2] == "before it"
    cover = {r.did: (min(s.s for s in r.cover), max(s.e for s in r.cover)) for r in suffixes.repeated_bytes(table).collect()}
    start = len(" ".join(words[:70_000])) + 1
    assert cover[2][1] == len(rows[1][1]) and cover[1][0] in (start - 1, start) and cover[1][1] - cover[1][0] == cover[2][1] - cover[2][0]
    tokens = bpe.encode_documents(table, bpe.public_file(), decoded="text")
    assert {r.doc_id: r.text for r in tokens.collect()} == {r[0]: r[1] for r in rows}
