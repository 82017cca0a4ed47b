"""Operators that SQL cannot express against plain versions written another way."""

import math
import os
import random
from html.parser import HTMLParser

import corpus_pipeline
import pytest
import regex
import xxhash
from pyspark.sql import functions as F
from test_near_copies import plain_parts
from test_operators import DOCS, labelled, plain_hits, rows, sha

from quern.llm import bpe, html_text, quality, spotsigs, toxicity

# toxicity


def plain_score(lexicon, text):
    """Every entry is tried at every place of the folded text."""
    folded = toxicity.fold(text or "")
    hidden = [(at, at + len(p) + 1) for p in lexicon.exceptions for at in range(len(folded)) if folded.startswith(f" {p} ", at)]
    total = 0.0
    for at in range(len(folded)):
        best = max([w for e, w in lexicon.weights.items() if folded.startswith(e, at)], default=0)
        if best > 0 and not any(a <= at < b for a, b in hidden):
            total += best
    bias, a, b = lexicon.scale
    x = bias + a * math.log1p(total) + b * math.log1p(10 * total / math.sqrt(max(1, folded.count(" ") - 1)))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def test_toxicity_plain(spark):
    data, labels = labelled(31, 200)
    data += [(900, None), (901, ""), (902, "trash can scum"), (903, "m0r0n " * 3000), (None, "you idiot"), (5, data[5][1])]
    docs, lab = spark.createDataFrame(data, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    lexicon = toxicity.learn(docs, lab)
    got = toxicity.score(docs.withColumn("toxicity", F.lit("x")).withColumn("score", F.lit(1)), lexicon)
    assert got.columns == ["doc_id", "text", "score", "toxicity"]
    want = {t: plain_score(lexicon, t) for _, t in data}
    assert all(r["toxicity"] == pytest.approx(want[r["text"]]) for r in got.collect()) and got.count() == len(data)
    held = {r["doc_id"]: r["held_out"] for r in toxicity.scored(docs, lab).collect()}
    assert held[None] is True  # the empty text's remainder is 0


# quality


def plain_quality(field, text):
    """Forward and backward sums line by line, in logarithms."""
    lines = (text or "").encode().split(b"\n")
    x, sizes, _ = quality.document_features([(text or "").encode()])
    emit = [(0.0, float(v @ field.weights)) for v in x]
    add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
    fore = [emit[0]]
    for e in emit[1:]:
        fore.append(tuple(e[s] + add(fore[-1][0] + field.moves[0, s], fore[-1][1] + field.moves[1, s]) for s in (0, 1)))
    back = [(0.0, 0.0)]
    for e in reversed(emit[1:]):
        back.append(tuple(add(field.moves[s, 0] + e[0] + back[-1][0], field.moves[s, 1] + e[1] + back[-1][1]) for s in (0, 1)))
    back.reverse()
    good = [1 / (1 + math.exp((f[0] + b[0]) - (f[1] + b[1]))) for f, b in zip(fore, back, strict=True)]
    assert len(good) == len(lines)
    mean = min(1 - 1e-6, max(1e-6, sum(g * s for g, s in zip(good, sizes, strict=True)) / sum(sizes)))
    return 1 / (1 + math.exp(-max(-30, min(30, field.scale[0] * math.log(mean / (1 - mean)) + field.scale[1]))))


def test_quality_plain(spark):
    data, labels = labelled(32, 150)
    data += [(900, None), (901, ""), (902, "\n\n"), (903, "bad $$$ line\n" * 1000 + "a good line of words follows here"), (None, "x")]
    docs, lab = spark.createDataFrame(data, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    field = quality.learn(docs, lab)
    got = quality.score(docs.withColumn("quality_score", F.lit("x")).withColumn("score", F.lit(1)), field)
    assert got.columns == ["doc_id", "text", "score", "quality_score"]
    assert all(r["quality_score"] == pytest.approx(plain_quality(field, r["text"]), abs=1e-9) for r in got.collect())
    assert all(r["held_out"] is not None for r in quality.scored(docs, lab).collect())


def test_quality_learns_from_all_lines(spark):
    """Documents of 1,000 lines that differ in the last third only, at places that a sample would miss."""
    r = random.Random(5)
    data, labels = [], []
    for i in range(60):
        good = i % 2
        body = ["plain words of a line"] * 1000
        for k in r.sample(range(700, 1000), 200):
            body[k] = "plain words of a line" if good else "%%% *** ### @@@"
        data.append((i, "\n".join(body)))
        labels.append((i, good, 0))
    got = quality.scored(spark.createDataFrame(data, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert all(x["predicted"] == x["doc_id"] % 2 for x in got)


# fingerprints


def plain_signatures(text, chain=spotsigs.CHAIN):
    words = regex.findall(r"[\p{L}\p{N}]+", text.lower())
    content = [i for i, w in enumerate(words) if w not in spotsigs.COMMON]

    def hashed(*parts):
        h = 42
        for p in parts:
            h = xxhash.xxh64_intdigest(p.encode(), h)
        return h & 0xFFFFFFFF

    out = set()
    for j, at in enumerate(content):
        if j == 0 or at - content[j - 1] > 1:
            out.add(hashed(words[at - 1] if at else "", *[words[content[j + k]] for k in range(chain) if j + k < len(content)]))
    return out or {hashed("whole", text)}


def test_spotsigs_plain(spark):
    r = random.Random(8)
    text = lambda: " ".join(r.choice(["the", "Of", "der", "un", "alpha", "beta,", "gamma-ray", "delta", "été", "x1", "—"]) for _ in range(r.randint(0, 60)))
    data = [(i, text()) for i in range(80)] + [(200, None), (201, ""), (202, "the of der"), (203, "alpha"), (204, "the alpha beta " * 6000), (300, text()), (301, text())]
    order = sorted(((i, t or "") for i, t in data), reverse=True)
    got = {x["doc_id"]: x for x in spotsigs.fingerprints(spark.createDataFrame(data, DOCS).withColumn("signs", F.lit(1)).repartition(5)).collect()}
    printed = lambda s: "".join(f"{x:08x}" for x in sorted(s))
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        own, other, nxt = plain_signatures(t), plain_signatures(edited), plain_signatures(after)
        x = got[i]
        assert (x["n_chars"], x["edited_sha256"], x["fingerprint"], x["edited_fingerprint"]) == (len(t), sha(edited), printed(own), printed(other))
        assert x["near_edited"] == pytest.approx(len(own & other) / len(own | other)) and x["near_next"] == pytest.approx(len(own & nxt) / len(own | nxt))
    assert spotsigs.fingerprints(spark.createDataFrame([], DOCS)).count() == 0


# pages


class Article(HTMLParser):
    """The leaf blocks inside <article>."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.out, self.held = 0, [], []

    def flush(self):
        text = " ".join("".join(self.held).split())
        if text and self.depth:
            self.out.append(text)
        self.held = []

    def handle_starttag(self, tag, attrs):
        if tag not in html_text.INLINE:
            self.flush()
        self.depth += tag == "article"

    def handle_endtag(self, tag):
        if tag not in html_text.INLINE:
            self.flush()
        self.depth -= tag == "article"

    def handle_data(self, data):
        self.held.append(data)


PAGES = "/root/testdata/sf0.01/pages.parquet"


@pytest.mark.skipif(not os.path.exists(PAGES), reason="no test tables")
def test_pages_of_the_test_tables(spark):
    """The article of every page that has one such element and is whole."""
    pages = spark.read.parquet(PAGES)
    got, seen = {r["page_id"]: r for r in html_text.extract(pages.withColumn("text", F.lit("x"))).collect()}, 0
    for r in pages.collect():
        if "<article" in (r["html"] or "") and "</article>" in r["html"]:
            parser = Article()
            parser.feed(r["html"])
            seen += 1
            assert got[r["page_id"]]["text"] == "\n".join(parser.out)
    assert seen > 100


def test_blocks_count_whole(spark):
    """What a block of 500 words is follows from all of them: its vector changes with the last."""
    words = [f"w{i}" for i in range(500)]
    a, b = (html_text.vectors([html_text.Block(" ".join([*words[:-1], w]), ("p",), 0)]) for w in ("end", "other"))
    assert (a != b).any()
    a, b = (html_text.vectors([html_text.Block("x" * 400 + t, ("p",), 0)]) for t in ("123", "abc"))
    assert (a != b).any()
    empty = html_text.extract(spark.createDataFrame([], "page_id long, url string, html string"))
    assert empty.count() == 0 and empty.columns == ["page_id", "url", "text", "n_chars"]
    long = "<article>" + "".join(f"<p>Sentence number {i} of a long article.</p>" for i in range(3000)) + "</article>"
    got = html_text.extract(spark.createDataFrame([(None, None, long), (None, None, long)], "page_id long, url string, html string")).collect()
    assert got[0]["text"] == got[1]["text"] == "\n".join(f"Sentence number {i} of a long article." for i in range(3000))


# pipeline


def test_pipeline_plain(spark, tmp_path):
    """All stages over a corpus with copies, shared lines, insults and leaks, against a plain version of each."""
    tokenizers = pytest.importorskip("tokenizers")
    r = random.Random(41)
    data, labels = labelled(33, 160)
    data = [(i, t + "\nshared line\n" if i % 9 == 0 else t) for i, t in data]
    words = lambda t: t.split(" ")
    for k in range(40):
        w = words(data[k][1])
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = f"edit{r.randrange(1000)}"
        data.append((1000 + k, " ".join(w)))
    items = [(1, " ".join(data[7][1].split()[2:15])), (2, "goes nowhere"), (3, " ".join(data[20][1].split()[:9]))]
    data += [(2000, None), (2001, ""), (2002, f"x {items[1][1]} y"), (2003, " ".join(f"t{i}" for i in range(6000)))]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    lexicon = toxicity.learn(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    kept = [(i, t) for i, t in data if plain_score(lexicon, t) < 0.5]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    held = {}
    for i, t in kept:
        for x in (t or "").split("\n"):
            held.setdefault(key(x), set()).add(i)
    kept = [(i, "\n".join(x for x in (t or "").split("\n") if not key(x) or len(held[key(x)]) < 10)) for i, t in kept]
    part = plain_parts([t for _, t in kept])
    first = {}
    for p, (i, _) in zip(part, kept, strict=True):
        first[p] = min(first.get(p, i), i)
    kept = [(i, t) for p, (i, t) in zip(part, kept, strict=True) if first[p] == i]
    bad = {i for i, _, _, _, hit in plain_hits(kept, items, 10) if hit}
    kept = [(i, t) for i, t in kept if i not in bad]
    library = tokenizers.Tokenizer.from_file(bpe.default_path())
    want = [(i, library.encode(t, add_special_tokens=False).ids) for i, t in kept]
    assert rows(corpus_pipeline.run(spark, str(tmp_path)), "doc_id", "token_ids") == sorted(want, key=str)
    assert 0 < len(bad) and len(want) < 150
