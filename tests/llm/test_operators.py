"""The training-data operators against plain versions on small fixtures, with the awkward cases."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quern.llm import bpe, chat, common, decontaminate, html_text, line_dedup, quality, simhash, spotsigs, substring_dedup, toxicity
from quern.llm.common import components, fold_of, remainder_of_id

DOCS = "doc_id long, text string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def made(seed: int, n: int = 60) -> list[tuple]:
    """Documents with shared lines and passages, copies, empty, null and long texts, and repeated rows."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 4)))
    sentence = lambda k: " ".join(word() for _ in range(k))
    common, passage = ["  Subscribe NOW\t", "Copyright É", "home"], sentence(40)
    out = []
    for i in range(n):
        lines = [sentence(r.randint(0, 30)) for _ in range(r.randint(1, 6))] + r.sample(common, r.randint(0, 3))
        if i % 4 == 0:
            lines.append(passage)
        r.shuffle(lines)
        out.append((i, "\n".join(lines)))
    out += [(n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, sentence(9000)), (n + 4, "der " * 200), (n + 5, out[3][1]), (n + 6, out[3][1])]
    return out + [out[5], out[5]]  # repeated rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made(1), DOCS).repartition(5).cache()


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


# lines


def plain_lines(data, least):
    keys = lambda t: [x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)}) for x in (t or "").split("\n")]
    held = Counter(k for _, k in {(i, k) for i, t in data for k in keys(t)})
    out = []
    for i, t in data:
        lines = (t or "").split("\n")
        kept = [x for x, k in zip(lines, keys(t)) if not k or held[k] < least]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_lines(docs, limit):
    got = line_dedup.dedup_lines(docs, min_docs=5, broadcast_limit=limit, digests=True)
    assert rows(got, "doc_id", "n_lines", "n_dropped", "kept_sha256") == plain_lines(made(1), 5)


def test_lines_are_reversible(spark):
    a, b = made(2, 30), made(3, 30)
    first, second = spark.createDataFrame(a, DOCS), spark.createDataFrame([(i + 1000, t) for i, t in b], DOCS)
    index = line_dedup.LineIndex(spark, 3, 1, 2).insert(first)
    before = rows(index.counts, "key", "refs")
    grown = index.insert(second)
    assert rows(line_dedup.dedup_lines(first, grown, digests=True), "doc_id", "n_lines", "n_dropped", "kept_sha256") != rows(line_dedup.dedup_lines(first, index, digests=True), "doc_id", "n_lines", "n_dropped", "kept_sha256")
    back = grown.delete(second)
    assert rows(back.counts, "key", "refs") == before
    assert rows(line_dedup.dedup_lines(first, back, digests=True), "doc_id", "n_lines", "n_dropped", "kept_sha256") == plain_lines(a, 3)


def test_lines_of_one_document(spark):
    """Ten rows of one id are one document; rows of one id keep results of their own."""
    data = [(1, f"only here\nx{i}") for i in range(10)] + [(None, "nameless")] * 12 + [(i, "everywhere") for i in range(1, 12)]
    df = spark.createDataFrame(data, DOCS)
    for limit in (64 << 20, 0):
        got = line_dedup.dedup_lines(df.withColumn("hits", F.lit(1)).withColumn("mark", F.lit(2)), broadcast_limit=limit)
        assert rows(got.groupBy("doc_id").agg(F.sum("n_lines").alias("n"), F.sum("n_dropped").alias("k")), "doc_id", "n", "k") == sorted([(1, 21, 1), (None, 12, 0), *((i, 1, 1) for i in range(2, 12))], key=str)
        assert got.columns == ["doc_id", "text", "hits", "mark", "n_lines", "n_dropped"]


def test_lines_keep_columns(spark):
    df = spark.createDataFrame([(1, "a\nb", 9, "x"), (2, "a", 9, None), (None, "a", 9, None)], "doc_id long, text string, n_lines long, source string")
    got = line_dedup.dedup_lines(df, min_docs=3)
    assert got.columns == ["doc_id", "text", "source", "n_lines", "n_dropped"]
    assert rows(got, "doc_id", "text", "n_lines", "n_dropped") == sorted([(1, "b", 2, 1), (2, "", 1, 1), (None, "", 1, 1)], key=str)
    assert line_dedup.dedup_lines(df.where("doc_id < 0")).count() == 0


def test_cuckoo_filter():
    keys = [hashlib.blake2b(str(i).encode(), digest_size=16).digest() for i in range(5000)]
    f = line_dedup.CuckooFilter.built(keys)
    held = line_dedup.split(b"".join(keys))
    assert f.contains(held).all()
    other = line_dedup.split(b"".join(hashlib.blake2b(f"x{i}".encode(), digest_size=16).digest() for i in range(20000)))
    assert f.contains(other).mean() < 0.002
    assert all(f.delete(k) for k in keys[:2500]) and f.items == 2500
    assert f.contains(held[2500:]).all() and f.contains(held[:2500]).mean() < 0.01


# passages


def plain_passages(data, width):
    words = [[w for w in (t or "").translate({c: 32 for c in (9, 10, 11, 12, 13)}).split(" ") if w] for _, t in data]
    places = Counter(tuple(w[p : p + width]) for w in words for p in range(len(w) - width + 1))
    out = []
    for (i, _), w in zip(data, words):
        gone = set()
        for p in range(len(w) - width + 1):
            if places[tuple(w[p : p + width])] > 1:
                gone.update(range(p, p + width))
        out.append((i, len(w), len(gone), sha(" ".join(x for p, x in enumerate(w) if p not in gone))))
    return sorted(out, key=str)


@pytest.mark.parametrize(("width", "limit", "batches"), [(35, 64 << 20, 2), (35, 0, 1), (12, 64 << 20, 5)])
def test_passages(docs, width, limit, batches):
    got = substring_dedup.dedup_substrings(docs, width, batches, limit, digests=True)
    assert rows(got, "doc_id", "n_words", "n_removed", "kept_sha256") == plain_passages(made(1), width)


def test_passages_in_small_shards(spark, monkeypatch):
    """A bitmap too small for its fingerprints lets nearly all windows through, to as many shards as they ask for; common ones are dealt."""
    monkeypatch.setattr(substring_dedup, "SHARD_WINDOWS", 500)
    monkeypatch.setattr(common, "PIECE", 8)
    monkeypatch.setattr(substring_dedup, "DEALT", 3)
    data = made(12, 40) + [(500 + i, t) for i, t in made(12, 20)]
    docs = spark.createDataFrame(data, DOCS).repartition(6)
    index = substring_dedup.FingerprintIndex.create(spark, keeps=False).append(docs)
    deal = substring_dedup.dealer(index, index.candidates(), 0)
    assert deal.shards > 4 and np.unpackbits(deal.bitmap).mean() > 0.9
    got = substring_dedup.dedup_substrings(docs, limit=0, digests=True)
    assert rows(got, "doc_id", "n_words", "n_removed", "kept_sha256") == plain_passages(data, 35)


def test_passages_batch_by_batch(spark, monkeypatch):
    """Each batch is judged by itself and all batches before, whose documents are gone."""
    monkeypatch.setattr(substring_dedup, "FAN_IN", 3)
    parts = [made(20, 12), made(21, 12), [(i + 700, t) for i, t in made(20, 9)] + made(22, 5), made(21, 15)]
    index, before = substring_dedup.FingerprintIndex.create(spark, width=12), []
    split = lambda t: [w for w in (t or "").translate({c: 32 for c in (9, 10, 11, 12, 13)}).split(" ") if w]
    for part in parts:
        got, index = substring_dedup.dedup_batch(spark.createDataFrame(part, DOCS), index, digests=True)
        places = Counter(tuple(w[p : p + 12]) for _, t in part + before for w in [split(t)] for p in range(len(w) - 11))
        want = []
        for i, t in part:
            w = split(t)
            gone = {q for p in range(len(w) - 11) if places[tuple(w[p : p + 12])] > 1 for q in range(p, p + 12)}
            want.append((i, len(w), len(gone), sha(" ".join(x for p, x in enumerate(w) if p not in gone))))
        assert rows(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=str)
        before += part
    assert len(index.runs) < 3 and substring_dedup.dedup_batch(spark.createDataFrame([], DOCS), index)[0].count() == 0


def test_passages_periodic(spark):
    data = [(1, "a b " * 18), (2, "x " * 35), (3, "x " * 36), (4, " ".join(map(str, range(60)))), (None, "q " * 40), (4, "q " * 40)]
    got = substring_dedup.dedup_substrings(spark.createDataFrame(data, DOCS), digests=True)
    assert rows(got, "doc_id", "n_words", "n_removed", "kept_sha256") == plain_passages(data, 35)
    empty = substring_dedup.dedup_substrings(spark.createDataFrame([], DOCS + ", n_words string"))
    assert empty.count() == 0 and empty.columns == ["doc_id", "text", "n_words", "n_removed"]


# SimHash


def plain_fingerprint(text):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def plain_components(ids, prints, radius):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    low = defaultdict(list)
    for i in range(len(ids)):
        low[root(i)].append(ids[i])
    return {i: min(low[root(i)]) for i in range(len(ids))}


def test_simhash(docs):
    data = made(1)
    prints = [plain_fingerprint(t) for _, t in data]
    of = plain_components([i for i, _ in data], prints, 2)
    got = simhash.near_duplicates(docs).select("doc_id", "component_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("f"))
    assert rows(got, "doc_id", "f", "component_id") == sorted([(i, f"{p:016x}", of[k]) for k, ((i, _), p) in enumerate(zip(data, prints))], key=str)
    assert sorted(r["doc_id"] for r in simhash.keep_first(docs).collect()) == sorted(set(of.values()))


def test_hot_keys(spark, monkeypatch):
    """A join by a key that many rows have gives the same rows, whether it is broadcast or not."""
    monkeypatch.setattr(common, "HOT", 10)
    left = spark.createDataFrame([(i, 7 if i % 2 else i % 20) for i in range(100)], "doc_id long, k long")
    right = spark.createDataFrame([(k, f"v{k}") for k in range(15)], "k long, v string")
    assert rows(common.joined_by_key(left, right, "k"), "doc_id", "k", "v") == rows(left.join(right, "k"), "doc_id", "k", "v")


@pytest.mark.parametrize("split", [5, 200])
def test_links(spark, monkeypatch, split):
    monkeypatch.setattr(simhash, "SPLIT", split)
    r = random.Random(4)
    values = set()
    for _ in range(12):
        v = r.getrandbits(64)
        for _ in range(25):
            values.add(v)
            v ^= 1 << r.randrange(64)
            if r.random() < 0.5:
                v ^= 1 << r.randrange(64)
    values = sorted(values)
    signed = [v - (v >> 63 << 64) for v in values]
    got = {r["node"]: r["root"] for r in components(simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"))).collect()}
    of = plain_components(signed, values, 2)
    want = defaultdict(set)
    have = defaultdict(set)
    for k, v in enumerate(signed):
        want[of[k]].add(v)
        have[got.get(v, v)].add(v)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, have.values()))
    tree = simhash.BKTree(values)
    for v in values[:20]:
        assert sorted(tree.within(v, 3)) == [i for i, x in enumerate(values) if (x ^ v).bit_count() <= 3]


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_components(spark, monkeypatch, most):
    monkeypatch.setattr(common, "ONE_TASK_LINKS", most)
    chain = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(200, 100), (300, 100)], "a long, b long")
    got = dict(rows(components(chain), "node", "root"))
    assert set(got.values()) == {0, 100} and got[40] == 0 and got[300] == 100
    assert components(chain.where("a < 0")).count() == 0


def test_simhash_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    got = rows(simhash.near_duplicates(spark.createDataFrame([(3, None), (2, ""), (9, "a")], DOCS)), "doc_id", "component_id")
    assert got == [(2, 2), (3, 2), (9, 9)]


# benchmark


def plain_hits(data, items, width):
    split = lambda t: "".join(c if ord(c) > 127 or c.isalnum() else " " for c in (t or "").translate({c: c + 32 for c in range(65, 91)})).split(" ")
    windows = defaultdict(set)
    for i, t in items:
        w = [x for x in split(t) if x]
        for p in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[p : p + width])].add(str(i))
    out = []
    for i, t in data:
        w = [x for x in split(t) if x]
        hit, ids = set(), set()
        for k in {len(x) for x in windows}:
            for p in range(len(w) - k + 1):
                if got := windows.get(tuple(w[p : p + k])):
                    hit.update(range(p, p + k))
                    ids |= got
        out.append((i, len(w), len(hit), sorted(ids), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_decontamination(spark, docs, limit, monkeypatch):
    monkeypatch.setattr(common, "PIECE", 8 if limit == 0 else 4096)
    data = made(1)
    words = data[8][1].split()
    items = [(1, " ".join(words[2:18]).upper()), (2, data[9][1][:70]), (10, "home"), (3, None), (4, "..."), (5, "home"), (1, " ".join(words[2:18]))]
    got = decontaminate.decontaminate(docs.withColumn("n_hit", F.lit("x")).withColumn("key", F.lit("k")).withColumn("_spans", F.lit(0)), spark.createDataFrame(items, "item_id long, text string"), limit=limit)
    assert rows(got, "doc_id", "n_words", "n_hit", "items", "contaminated") == plain_hits(data, items, 10)
    assert got.columns == ["doc_id", "text", "key", "_spans", "n_words", "n_hit", "items", "contaminated"]
    none = decontaminate.decontaminate(docs, spark.createDataFrame([], "item_id long, text string"))
    assert none.where("contaminated").count() == 0 and none.count() == len(data)


# fingerprints


def test_spotsigs(spark, docs):
    got = {}
    data = made(1)
    out = spotsigs.fingerprints(docs).collect()
    assert len(out) == len(data)
    order = sorted({i: t or "" for i, t in data}.items(), reverse=True)
    follow = {order[k][0]: order[(k + 1) % len(order)] for k in range(len(order))}
    text = dict(order)
    repeated = {i for i, n in Counter(i for i, _ in data).items() if n > 1}
    for r in out:
        t = text[r["doc_id"]]
        got[r["doc_id"]] = r["fingerprint"]
        if r["doc_id"] not in repeated:
            cut = len(t) // 3
            assert (r["n_chars"], r["edited_sha256"]) == (len(t), sha(t[: len(t) - cut] + follow[r["doc_id"]][1][:cut]))
        a, b = ({x[k : k + 8] for k in range(0, len(x), 8)} for x in (r["fingerprint"], r["edited_fingerprint"]))
        assert r["near_edited"] == pytest.approx(len(a & b) / len(a | b)) and 0 <= r["near_next"] <= 1
    assert got[65] == got[66] == got[3] and got[60] == got[61]


def test_next_document_across_spans(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "SPAN", 4)
    monkeypatch.setattr(spotsigs, "ONE_TASK", 4)
    ids = [0, 1, 2, 3, 4, 9, 77, 78, 1000, 5000, 5001, 5002, 10**12, -5]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], DOCS)
    got = {r["doc_id"]: r["nxt"]["text"] for r in spotsigs.with_next(df, ["text"]).collect()}
    order = sorted(ids, reverse=True)
    assert got == {order[k]: f"t{order[(k + 1) % len(order)]}" for k in range(len(order))}


def test_similar_pairs(spark):
    r = random.Random(5)
    words = ["".join(r.choice("bcdfgklmn") for _ in range(5)) for _ in range(400)]
    base = [[w for _ in range(60) for w in (r.choice(["the", "of", "der"]), r.choice(words), r.choice(words))] for _ in range(30)]
    data = []
    for k, b in enumerate(base):
        data.append((10 * k, " ".join(b)))
        for j in range(1, 4):
            c = list(b)
            for _ in range(j * 3):
                c[r.randrange(len(c))] = r.choice(words)
            data.append((10 * k + j, " ".join(c)))
    data.append((999, data[0][1]))
    df = spark.createDataFrame(data, DOCS)
    sets = {i: s for i, s in rows(df.select("doc_id", spotsigs.signatures(F.col("text")).alias("s")), "doc_id", "s")}
    members, pairs = spotsigs.similar_pairs(df)
    of = dict(rows(members, "doc_id", "class_id"))
    assert of[999] == of[0] == 0
    names = sorted(set(of.values()))
    want = {(a, b) for a in names for b in names if a < b and len(set(sets[a]) & set(sets[b])) >= 0.8 * len(set(sets[a]) | set(sets[b])) - 1e-12}
    assert {(a, b) for a, b, _ in rows(pairs, "left_id", "right_id", "likeness")} == want and want


def test_spotsigs_plan_has_no_python(docs):
    from quern.plans.explain import summary

    assert summary(spotsigs.fingerprints(docs))["python"] == 0


# chat


def test_chat(spark):
    def turns(c, *texts):
        return [(c, k, ("user", "assistant")[k % 2], t) for k, t in enumerate(texts)]

    data = turns(1, "a", "b") + turns(2, "a", "b", "c", "d") + turns(3, "a", "x") + turns(4, "a", "x") + turns(5, "a") + turns(6, "a", "b", "c", "e") + turns(7, None) + [(8, None, None, "z"), (8, None, None, "z")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(0))
    got = rows(chat.formatted(df), "conv_id", "n_turns")
    assert got == [(2, 4), (3, 2), (6, 4), (7, 1), (8, 1)]
    assert chat.formatted(df).where("conv_id = 3").first()["rendered"] == "<|user|>\na\n<|assistant|>\nx\n"
    assert chat.formatted(df.where("conv_id < 0")).count() == 0


def test_chat_plain(spark):
    """Random conversations, many of them snapshots of others, against all pairs."""
    r = random.Random(2)
    data, whole = [], {}
    for c in range(120):
        base = whole[r.randrange(c)] if c and r.random() < 0.6 else ()
        turns = (*base[: r.randint(0, len(base))], *(r.choice("abc") for _ in range(r.randint(0 if base else 1, 4))))
        whole[c] = turns or ("z",)
        data += [(c, k, "u", t) for k, t in enumerate(whole[c])]
    want = {c for c, t in whole.items() if not any(x[: len(t)] == t and (len(x) > len(t) or d < c) for d, x in whole.items() if d != c)}
    got = chat.formatted(spark.createDataFrame(data, "conv_id long, turn long, role string, text string")).collect()
    assert {x["conv_id"] for x in got} == want
    assert all(x["rendered"] == "".join(f"<|u|>\n{t}\n" for t in whole[x["conv_id"]]) and x["n_turns"] == len(whole[x["conv_id"]]) for x in got)


def test_chat_long(spark):
    """Linear in a conversation's turns."""
    df = spark.range(30_000).selectExpr("1L as conv_id", "id as turn", "'u' as role", "'t' as text")
    assert rows(chat.formatted(df), "conv_id", "n_turns") == [(1, 30_000)]


# BPE


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(bpe.default_path())


def test_bpe(spark, library):
    r = random.Random(6)
    texts = ["", "a", "don't we'll 123 $$$", "ΣΑΣ", "<|endoftext|> x<|startoftext|>", "x" * 3000, "ab" * 2000, "日本語 テキスト", "😀 é É", " a b"]
    texts += ["".join(r.choice("aehinorst' éß!$1") for _ in range(200)) for _ in range(150)] + [t or "" for _, t in made(7)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(9999, None)], DOCS)
    want = library.encode_batch(texts, add_special_tokens=False)
    got = dict(rows(bpe.encode(df), "doc_id", "token_ids"))
    assert all(got[i] == w.ids for i, w in enumerate(want)) and got[9999] == []
    digests = {r["doc_id"]: r for r in bpe.encode(df, digests=True).collect()}
    for i, w in enumerate(want):
        assert (digests[i]["n_tokens"], digests[i]["ids_sha256"], digests[i]["decoded_sha256"]) == (len(w.ids), hashlib.sha256(np.array(w.ids, "<u4").tobytes()).hexdigest(), sha(library.decode(w.ids, skip_special_tokens=False)))
    back = dict(rows(bpe.decode(bpe.encode(df)), "doc_id", "text"))
    v = bpe.encoder(bpe.default_path()).vocabulary
    assert all(back[i] == " ".join(v.words(t)) for i, t in enumerate(texts))
    assert bpe.encode(df.where("doc_id < 0")).count() == 0


def test_bpe_letters_of_all_code_points(library):
    """Every character beside letters and digits, where its class decides how the text is cut."""
    texts = ["".join(f"a{chr(c)}a 1{chr(c)}1 " for c in range(at, min(at + 64, 0x110000))) for at in range(0, 0x110000, 64) if not 0xD800 <= at < 0xE000]
    got = bpe.encoder(bpe.default_path()).encode(texts)
    for t, (ids, _), w in zip(texts, got, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == w.ids, hex(ord(t[1]))


def test_bpe_pairs_and_merges(library):
    v = bpe.Vocabulary(bpe.default_path())
    r = random.Random(8)
    tokens = [t for t in v.ids if not t.endswith("</w>") and 1 < len(t) < 6]
    ends = [t for t in v.ids if t.endswith("</w>") and len(t) < 10]
    pairs = [(r.choice(tokens), r.choice(ends)) for _ in range(3000)]
    fine = v.compatible(np.array([v.ids[a] for a, _ in pairs]), np.array([v.ids[b] for _, b in pairs]))
    for (a, b), f in zip(pairs, fine):
        assert (v.exact(a + b.removesuffix("</w>")) == [v.ids[a], v.ids[b]]) == f
    long = "".join(r.choice("etaoin") for _ in range(400))
    short, bpe.SHORT = bpe.SHORT, 10**6
    plain = v.exact(long)
    bpe.SHORT = short
    assert v.exact(long) == plain


# learned operators


def test_folds(spark):
    ids = [0, 1, 17, -4, 10**12, None]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "doc_id long").select(remainder_of_id("doc_id", 5)).collect()]
    assert got == fold_of(ids, 5)


def labelled(seed, n=400):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("bcdfgklmnaeiou") for _ in range(r.randint(2, 7)))
    data, labels = [], []
    for i in range(n):
        w = [word() for _ in range(r.randint(20, 120))]
        toxic, good = int(r.random() < 0.3), int(r.random() < 0.7)
        if toxic:
            for _ in range(3):
                w[r.randrange(len(w))] = r.choice(["idi0t", "m0ron", "ѕcum", "zorkel", "Zorkeling"])
        if not good:
            w = [f"{x}$$$" for x in w]
        data.append((i, "\n".join(" ".join(w[k : k + 12]) for k in range(0, len(w), 12))))
        labels.append((i, good, toxic))
    return data, labels


def test_toxicity(spark):
    data, labels = labelled(9)
    docs, lab = spark.createDataFrame(data + [(9000, None), (9001, "")], DOCS), spark.createDataFrame(labels + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.scored(docs, lab).collect()}
    held = [(got[i]["predicted"], t) for i, _, t in labels if got[i]["held_out"]]
    assert len(got) == 402 and 0 <= got[9000]["score"] == got[9001]["score"] < 0.5
    assert np.mean([p == t for p, t in held]) >= 0.95
    assert all(got[i]["held_out"] == (f == 0) for i, f in zip(range(400), fold_of(list(range(400)), 5)))
    none = toxicity.scored(docs.where("doc_id < 3"), lab.where("doc_id < 0"))
    assert none.count() == 3 and toxicity.scored(docs.where("doc_id < 0"), lab).count() == 0


def test_toxicity_folds_and_exceptions():
    assert toxicity.fold("An 1D10T, ѕсum! $tupid ＩＤＩＯＴ été") == " an idiot scum stupid idiot ete "
    a = toxicity.SEED.automaton()
    assert toxicity.matched(a, toxicity.fold("put it in the trash can")) == (0, 0)
    assert toxicity.matched(a, toxicity.fold("trash"))[0] > 0
    assert toxicity.matched(a, toxicity.fold("loserx"))[0] == 0


def test_quality(spark):
    data, labels = labelled(10)
    docs, lab = spark.createDataFrame(data + [(9000, None), (9001, "")], DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.scored(docs, lab).collect()}
    held = [(got[i]["predicted"], q) for i, q, _ in labels if got[i]["held_out"]]
    assert len(got) == 402 and np.mean([p == q for p, q in held]) >= 0.95 and got[9000]["score"] == got[9001]["score"]
    assert quality.scored(docs, lab.where("doc_id < 0")).count() == 402 and quality.scored(docs.where("doc_id < 0"), lab).count() == 0


def test_field_sums():
    """Forward-backward against all label sequences."""
    r = np.random.default_rng(3)
    f = quality.Field(r.normal(size=4), r.normal(size=(2, 2)))
    counts = np.array([3, 1, 5])
    x = r.normal(size=(9, 4))
    good, moved, total = f.marginals(x, counts)
    want, at, norm, moves = np.zeros(9), 0, 0.0, np.zeros((2, 2))
    for n in counts:
        z, own, step = 0.0, np.zeros(n), np.zeros((2, 2))
        for code in range(1 << n):
            y = [code >> k & 1 for k in range(n)]
            w = np.exp(sum(x[at + k] @ f.weights * y[k] for k in range(n)) + sum(f.moves[a, b] for a, b in zip(y, y[1:])))
            z += w
            own += w * np.array(y)
            for a, b in zip(y, y[1:]):
                step[a, b] += w
        want[at : at + n] = own / z
        moves += step / z
        norm += np.log(z)
        at += n
    assert good == pytest.approx(want) and moved == pytest.approx(moves) and total == pytest.approx(norm)


def test_html(spark):
    model = html_text.labeller()
    pages = html_text.sample_pages(120, seed=77)
    right = total = 0
    for page, truth in pages:
        x, mask = html_text._padded([html_text.vectors(html_text.blocks_of(page))])
        right += ((model.probabilities(x, mask)[0] > 0.5) == np.array(truth)).sum()
        total += len(truth)
    assert right / total >= 0.97
    page = '<html><head><title>t</title><script>if (a<b) {}</script></head><body><nav><a href="/">Home</a></nav><article><h1>Big &amp; small</h1><p>One\n two&nbsp;<b>three</b>.<p>Four<br>five<!-- no --></article><footer>&copy; us</footer></body></html>'
    data = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", page[:-60]), (5, "u", "<<>>&<p")]
    got = {r["page_id"]: r for r in html_text.extract(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert got[1]["text"] == "Big & small\nOne two three.\nFour\nfive" and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == got[3]["text"] == "" and len(got) == 5 and got[4]["text"].startswith("Big & small")


def test_gradients():
    """Back-propagation against differences."""
    m = html_text.Labeller(1)
    r = np.random.default_rng(2)
    x, mask = r.normal(size=(3, 4, html_text.WIDTH)) * 0.2, np.array([[1, 1, 1, 1], [1, 1, 0, 0], [1, 1, 1, 0]], bool)
    y = r.integers(0, 2, (3, 4)).astype(float)

    def loss():
        p = m.probabilities(x, mask)
        return -(np.where(y > 0, np.log(p), np.log(1 - p)) * mask).sum() / mask.sum()

    for w, g in zip(m.weights, m.gradients(x, mask, y)):
        k = tuple(r.integers(0, s) for s in w.shape)
        old = w[k]
        w[k] = old + 1e-5
        up = loss()
        w[k] = old - 1e-5
        down = loss()
        w[k] = old
        assert g[k] == pytest.approx((up - down) / 2e-5, abs=1e-6)
