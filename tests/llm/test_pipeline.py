"""The corpus pipeline against plain Python, and on rows with nulls, repeats, clashing names, and no rows."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F
from test_brute_force import WORDS, classes, leaks

import corpus_pipeline
from lodestar.llm import toxicity
from lodestar.llm.common import table


def md5(x):
    return hashlib.md5(x.encode()).hexdigest()


def mixed(rows):
    """rows: (doc_id, text, source). How often each is seen, by a walk over each source's permutation of the last epoch."""
    by = defaultdict(list)
    for d, t, s in rows:
        by[s].append((d, md5(t or ""), max(1, len(WORDS.findall(t or "")))))
    tokens = {s: sum(n for *_, n in v) for s, v in by.items()}
    total = sum(tokens.values())
    p, lo, hi = {s: n / total for s, n in tokens.items()}, 0.0, 1.0
    for _ in range(50):
        e = (lo + hi) / 2
        lo, hi = (lo, e) if (max(p.values()) / min(p.values())) ** (1 - e) <= 2.0 else (e, hi)
    z = sum(x**hi for x in p.values())
    w = {s: x**hi / z for s, x in p.items()}
    budget = max(tokens[s] / w[s] for s in p)
    seen = Counter()
    for s, v in by.items():
        want = math.floor(w[s] * budget + 0.5)
        last = max(0, math.ceil(want / tokens[s]) - 1)
        at = last * tokens[s]
        for d, t, n in sorted(v, key=lambda x: md5(f"0:{last}:{'' if x[0] is None else x[0]}:{x[1]}")):
            seen[d, t, s] += last + (at < want)
            at += n
    return seen


def shards(rows, n=40):
    """rows: (doc_id, text). Of each its shard, along the bytes in the order of digests."""
    size = lambda t: len((t or "").encode()) + 16
    order = sorted(rows, key=lambda r: md5(f"{'' if r[0] is None else r[0]}:{zlib.crc32((r[1] or '').encode())}:{size(r[1])}"))
    total, before, out = sum(size(t) for _, t in rows), 0, Counter()
    for d, t in order:
        out[d, t, min(n - 1, (2 * before + size(t)) * n // (2 * total))] += 1
        before += size(t)
    return out


def test_pipeline_against_plain_python(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(list(map(tuple, toxicity.sample(docs, labels).collect())))
    compress, codes = model.compressors(), toxicity.Codes()
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect() if model.value(compress.gains(codes.of(r["text"]))) <= model.threshold]
    found = classes([r[:2] for r in rows])
    least = {}
    for (d, *_), (c, _) in zip(rows, found, strict=True):
        least[c] = min(least.get(c, d), d)
    rows = [r for r, (c, _) in zip(rows, found, strict=True) if c is None or least[c] == r[0]]
    items = [r["text"] for r in table(spark, sf_dir, "benchmark").collect()]
    rows = [r for r in rows if not any(leaks(r[1], x) for x in items)]
    times = mixed(rows)
    many = [(d, t) for d, t, s in rows for _ in range(times[d, md5(t or ""), s])]
    got = corpus_pipeline.run(spark, sf_dir)
    assert set(got.columns) == {*docs.columns, "shard"}
    assert Counter((r["doc_id"], r["text"], r["shard"]) for r in got.collect()) == shards(many)


def test_stages_on_odd_rows_and_none(spark, sf_dir):
    same = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, None, "a"), (2, "", "a"), (3, same, None), (4, same, "a"), (4, same, "a"), (None, same + " more", "b"), (None, None, None), (6, "w " * 30_000, "a"), (6, "another text of that id, which nobody else has", "b"), (7, " \n", "b")]
    docs = spark.createDataFrame([(*r, 5, "k", "x", 9) for r in rows], "doc_id long, text string, source string, _copy int, _key string, class string, size int")
    for part, want in ((docs, Counter([(1, None), (2, ""), (3, same), (None, None), (6, "w " * 30_000), (6, rows[8][1]), (7, " \n")])), (docs.limit(0), Counter())):
        out = part
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, sf_dir)
            assert out.columns[: len(docs.columns)] == docs.columns, name
            out = out.cache()
        got = Counter((r["doc_id"], r["text"]) for r in out.collect())
        assert set(got) == set(want) and out.where("_copy <> 5 or _key <> 'k' or class <> 'x' or size <> 9").count() == 0
        assert out.where(F.col("shard").isNull()).count() == 0
