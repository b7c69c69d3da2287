"""The training-data operators against brute force, and their edge cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestar.llm import chat, decontaminate, jaccard, licenses, mixing, pii, quality, sharding, toxicity, urls
from lodestar.llm.common import table
from lodestar.llm.queries import ORACLE, QUERIES

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, rule string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, columns with clashing names."""
    same = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, None, "en", "a", 1, 1, "r"), (2, "", "en", "a", 1, 1, "r"), (3, same, None, None, None, None, None), (4, same, "en", "a", 1, 1, "r"), (4, same, "en", "a", 1, 1, "r"), (None, same, "de", "b", 1, 1, "r"), (6, "w " * 30000, "en", "a", 1, 1, "r"), (7, " \n\t ", "en", "b", 1, 1, "r")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 1), (3, 1, 0), (None, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    cur = con.execute(ORACLE[name])
    names = [x[0] for x in cur.description]
    assert got == sorted((tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()), key=repr)


def test_odd_rows_everywhere(spark, odd, labels):
    none = odd.limit(0)
    bench = spark.createDataFrame([(1, None), (2, "too short"), (3, "one two three four five six seven eight nine ten eleven twelve")], "item_id long, text string")
    ops = {"mix": mixing.mix, "join": jaccard.join, "judge": lambda d: quality.judge(d, labels), "leaks": lambda d: decontaminate.leaks(d, bench), "shard": sharding.shard, "pii": pii.scan, "licenses": licenses.scan, "toxicity": lambda d: toxicity.score(d, labels)}
    for name, op in ops.items():
        assert op(none).count() == 0, name
        n = op(odd).count()
        assert n == {"mix": n, "leaks": 3}.get(name, odd.count()), name
    for op in (lambda d: toxicity.without_toxic(d, labels), jaccard.one_of_each, lambda d: decontaminate.without_leaks(d, bench), mixing.mixed_rows):
        assert op(odd).columns == odd.columns
        assert op(none).count() == 0
    assert decontaminate.without_leaks(odd, bench).count() == 4
    assert {"shard", *odd.columns} == set(sharding.sharded_rows(odd).columns)
    pages = spark.createDataFrame([(1, None, "x"), (2, "no scheme", "x"), (3, "HTTP://A.Example.COM/en/7?q", "x"), (None, "s://com/en/#x", "y")], "page_id long, url string, host string")
    got = {r["page_id"]: tuple(r)[1:] for r in urls.judge(pages).collect()}
    assert got == {1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("a.example.com", "/en/7", "example.com/en/7", "allow"), None: ("com", "/en/", "com/en/", "block")}
    assert urls.judge(pages.limit(0)).count() == 0


def test_url_rules_against_all_of_them(spark):
    """The index fetches every rule that fits: the same verdicts as running all rules."""
    import random

    rnd = random.Random(7)
    hosts = ["a.com", "x.example.com", "example.com", "example.net", "b.net", "cheap-pills.org", "spam-farm.net", "my-online-casino.com", "free-downloads.net", "free-movies.org", "de.wikipedia.org", "mycom", "c.org"]
    paths = ["", "/", "/en/", "/en/7", "/en/70/x", "/de/", "/de/8", "/es/1", "/signin", "/cart/", "/checkout.php", "/a/login.html", "/loginx", "/x/wp-admin/y", "/wiki/Cart", "/wiki/cart"]
    rows = [(k, f"http://{rnd.choice(hosts)}{rnd.choice(paths)}") for k in range(2000)]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    for k, u in rows:
        fits = [r for r in urls.SCOPES + urls.PATTERNS if re.search(r.pattern, u[7:])]
        scope = max((r for r in fits if r.scope), key=lambda r: len(r.scope), default=None)
        actions = {r.action for r in fits if not r.scope}
        want = scope.action if scope else "allow" if "allow" in actions or not actions else "block"
        assert got[k] == (scope and scope.scope, want), u
    assert {v for _, v in got.values()} == {"allow", "block"}


def test_mixing_meets_its_targets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    tokens = mixing.token_table(docs)
    own = {r["source"]: r["n"] for r in tokens.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    rows = mixing.schedule(tokens, mixing.plan(tokens, block_tokens=20_000)).collect()
    seen, blocks = Counter(), defaultdict(list)
    for r in rows:
        seen[r["source"]] += r["tokens"]
        blocks[r["block"]].append(r["slot"])
    assert all(sorted(b) == list(range(len(b))) for b in blocks.values())
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.select("doc_id").collect()}  # nothing is left out
    longest = max(r["tokens"] for r in rows)
    assert all(n <= 2 * own[s] + longest for s, n in seen.items())
    weights = {r["source"]: r["weight"] for r in mixing.plan(tokens).collect()}
    total = sum(seen.values())
    assert all(abs(n - weights[s] * total) <= 2 * longest for s, n in seen.items())
    assert mixing.mixed_rows(docs, block_tokens=20_000).count() == len(rows)
    entropy = mixing.plan(tokens, max_repeats=None, entropy_share=0.9999).collect()
    import math

    assert -sum(r["weight"] * math.log(r["weight"]) for r in entropy) >= 0.9998 * math.log(len(own))


def test_jaccard_against_all_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").collect()

    def shingles(t):
        w = WORDS.findall(t or "")
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = {r["doc_id"]: shingles(r["text"]) for r in rows}
    ids, links, root = sorted(sets), Counter(), {d: d for d in sets}
    find = lambda x: x if root[x] == x else find(root[x])
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            i = len(sets[a] & sets[b])
            if i and i >= 0.8 * (len(sets[a]) + len(sets[b]) - i):
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.join(table(spark, sf_dir, "documents")).collect()}
    assert got == {d: (find(d), links[d]) for d in ids}


@pytest.mark.parametrize(("bound", "value"), [("BLOCK", 8), ("BLOCK_SHINGLES", 1500)])
def test_jaccard_blocks_of_near_copies(spark, monkeypatch, bound, value):
    monkeypatch.setattr(jaccard, bound, value)
    base = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join(base[:k] + ["x"] + base[k + 1 :])) for k in range(40)] + [(100 + k, " ".join(base)) for k in range(5)]
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["class_id"] for r in got} == {0} and {r["n_links"] for r in got} == {44}


def test_quality_guarantee(spark):
    import math

    cells = spark.createDataFrame([(n, k) for n in (50, 400, 3000) for k in (0, 1, 3, 20)], "n long, k long")
    for r in cells.withColumn("p", quality.binomial_tail(F.col("n"), F.col("k"), 0.01)).collect():
        want = sum(math.comb(r["n"], i) * 0.01**i * 0.99 ** (r["n"] - i) for i in range(r["k"] + 1)) if r["k"] < r["n"] * 0.01 else 1
        assert math.isclose(r["p"], want, rel_tol=1e-9)
    good = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame([(i, good.replace("word0", f"a{i}"), "en") for i in range(3000)] + [(5000, " ".join(f"w{i}###" for i in range(40)), "en"), (5001, " ".join(f"w{i}###" for i in range(40)), "xx")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(3000)], "doc_id long, quality int")
    bad = {r["doc_id"]: r["failed"] for r in quality.judge(docs, labels).where("not kept").collect()}
    assert bad == {5000: "symbols"}  # a stratum without labels rejects nothing


def test_quality_of_more_strata_than_are_broadcast(spark):
    good = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame([(2 * i + k, good.replace("word0", f"a{i}"), lang) for i in range(1500) for k, lang in enumerate(("en", None))] + [(5000 + k, " ".join(f"w{i}###" for i in range(40)), lang) for k, lang in enumerate(("en", None))], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(3000)], "doc_id long, quality int")
    for most in (1, 10_000):
        assert {r["doc_id"]: r["failed"] for r in quality.judge(docs, labels, max_strata=most).where("not kept").collect()} == {5000: "symbols", 5001: "symbols"}


def test_decontamination(spark, sf_dir):
    item = "A train leaves Springfield with 120 passengers and travels 300 km before Alice and another 120 people leave it at noon"
    other = item.replace("120", "75").replace("300", "410").replace("Alice", "Robert")
    torn = item.replace("120", "75", 1).replace("another 120", "another 76")
    docs = spark.createDataFrame([(1, "Intro text. " + other + ". The end"), (2, torn), (3, item.upper()), (4, "nothing of the kind is in here, not even a number of words that agree")], "doc_id long, text string")
    got = {r["doc_id"] for r in decontaminate.leaks(docs, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()}
    assert 1 in got and not got & {2, 4}
    # Rows without a doc_id, or that share one, stand for themselves.
    rows = [(None, item), (None, "Intro text. " + other), (None, torn), (None, "clean"), (5, item), (5, torn), (5, None)]
    mixed, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(9, item)], "item_id long, text string")
    assert sorted(decontaminate.without_leaks(mixed, bench).collect(), key=repr) == sorted([(5, None), (5, torn), (None, "clean"), (None, torn)], key=repr)
    assert {r["doc_id"] for r in decontaminate.leaks(mixed, bench).collect()} == {None, 5} and decontaminate.leaks(mixed, bench).count() == 2
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    plain = lambda t: " ".join(re.sub(r"[^\w\s]", "", t or "").lower().split())
    items = [(r["item_id"], plain(r["text"])) for r in bench.collect()]
    want = {(r["doc_id"], i) for r in docs.collect() for i, t in items if t and t in plain(r["text"])}
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()}
    assert want <= found


def test_decontamination_is_blind_to_case(spark):
    item = "A train leaves Springfield with 120 passengers and travels 300 km before Alice and another 120 people leave it at noon"
    names = "yesterday Anna Berta Clara Dora Emil Frida Gustav Hans Ida Jonas met"
    numbers = "add 1 2 3 4 5 6 7 8 9 10 11 12 13 14 up"
    bench = spark.createDataFrame([(1, item), (2, names), (3, numbers), (4, "die große Straße nach Köln und weiter bis Bonn ist heute wieder gesperrt")], "item_id long, text string")
    texts = [r["text"] for r in bench.collect()]
    forms = [f for t in texts for f in (t, t.upper(), t.title(), t.lower(), "Some words. " + t.upper() + " MORE WORDS")]
    other = item.upper().replace("120", "75").replace("300", "410")
    torn = item.upper().replace("120", "75", 1)
    docs = spark.createDataFrame(list(enumerate([*forms, other, torn, numbers.replace("7", "70")])), "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == {(5 * k + j, k + 1) for k in range(4) for j in range(5)} | {(20, 1)}


def test_sharding_is_balanced(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows, texts = sharding.shard(docs, 7).collect(), {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    total, largest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    by = defaultdict(list)
    for r in rows:
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(texts[r["doc_id"]]) + 16, zlib.crc32(texts[r["doc_id"]]), "bytes", None)
        by[r["shard"]].append(r)
    assert len(rows) == len(texts) and set(by) == set(range(7))
    for part in by.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
        assert abs(sum(r["size"] for r in part) - total / 7) <= largest
    again = {(r["doc_id"], r["shard"]) for r in sharding.sharded_rows(docs, 7).select("doc_id", "shard").collect()}
    assert again == {(r["doc_id"], r["shard"]) for r in rows}


def _luhn(digits):
    return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def _base(text):
    out = []
    digits = lambda s: re.sub("[^0-9]", "", s)
    checks = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))), ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and _luhn(digits(s))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15)]
    for kind, pattern, good in checks:
        out += [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, text or "") if good(m[0])]
    return out


def test_pii_against_patterns(spark, sf_dir):
    import random

    rnd, parts = random.Random(5), ["a", "@", "b.c", ".", "1", "22", "4111111111111111", " ", "-", "+", "(", ")", "255.1.2.3", "300", "é", "++1 22", "x@y.z", "4111 1111-1111 1111", "%", "\n", "1.2.3.4.5.6.7.8"]
    rows = [(k, "".join(rnd.choice(parts) for _ in range(rnd.randrange(40)))) for k in range(3000)] + [(-1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(table(spark, sf_dir, "documents").select("doc_id", "text"))
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = Counter((d, hashlib.sha256(",".join(b).encode()).hexdigest(), *(sum(x.startswith(k + ":") for x in b) for k in pii.BASE)) for d, b in ((d, _base(t)) for d, t in texts))
    got = Counter((r["doc_id"], r["base_sha256"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in pii.scan(docs).collect())
    assert got == want
    extra = {
        'account no: 1234-5678-90 and token = "abcdefabcdefabcdef" at https://ex.org/p?x=1.': "url:61:81,account:12:24,secret:38:56",
        "IBAN GB29 NWBK 6016 1331 9268 19 is fine": "account:5:32",
        "account 12345678 was 5 years old": "account:8:16",
        "account numbers 2024 rose": "",
        "passport" * 2000: "",
        "x://" * 200_000: "",
    }
    got = {r["doc_id"]: r["spans"] for r in pii.scan(spark.createDataFrame(list(enumerate(extra)), "doc_id long, text string")).collect()}
    assert {k: ",".join(x for x in got[k].split(",") if x.split(":")[0] not in pii.BASE) for k in got} == dict(enumerate(extra.values()))


def test_licenses(spark):
    rows = [(1, "Copyright (c) 2020 X\n" + licenses.TEXTS["MIT"].upper().replace("\n", "\n\n")), (2, "Some text.\nReleased under the MIT Licence!"), (3, licenses.TEXTS["BSD-3-Clause"] + " more"), (4, None), (5, licenses.TEXTS["MIT"] + "\nи ещё 许可"), (6, "许可 !!"), (7, "?!")]
    got = {r["doc_id"]: (r["license"], r["notices"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("MIT", ""), 2: (None, "MIT"), 3: (None, ""), 4: (None, ""), 5: (None, ""), 6: (None, ""), 7: (None, "")}


def test_chat(spark):
    call = '{"tool_calls":[{"id":"b","name":"search","arguments":"{\\"query\\":\\"x\\"}","depends_on":["a"]},{"id":"a","name":"search","arguments":"{\\"query\\":5}"},{"id":"z","name":"search","arguments":"{}","depends_on":["zz"]}]}'
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", call), (1, 2, "tool", '{"tool_call_id":"a","content":"7"}'), (1, 3, "tool", '{"tool_call_id":"q","content":"7"}'), (1, 4, "assistant", "{broken"), (2, 0, None, None)]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = [(r["kind"], r["call_id"], r["status"], r["valid"]) for r in chat.format_chat(m).orderBy("conv_id", "turn", "rank", "part").collect()]
    assert got == [("message", None, "none", True), ("call", "a", "linked", False), ("call", "z", "pending", False), ("result", "a", "linked", True), ("call", "b", "pending", True), ("result", "q", "orphan", False), ("message", None, "none", True), ("message", None, "none", True)]


def test_chat_keeps_what_is_said_beside_calls(spark):
    rows = [(1, 0, "assistant", '{"content":"Let me look","tool_calls":[{"id":"a","name":"search","arguments":"{}"}],"z":{"b":[1]},"mood":"calm"}'), (1, 1, "tool", '{"tool_call_id":"a","content":"7","name":"search","is_error":true}')]
    got = [(r["kind"], r["rank"], r["json"]) for r in chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "turn", "rank", "part").collect()]
    assert [(k, n) for k, n, _ in got] == [("message", -1), ("call", 0), ("result", 1)]
    assert got[0][2] == '{"content":"Let me look","fields":{"mood":"calm","z":{"b":[1]}},"role":"assistant"}'
    assert got[2][2] == '{"content":"7","fields":{"is_error":true,"name":"search"},"role":"tool","tool_call_id":"a"}'


def _labelled(d):
    return duckdb.sql(f"SELECT doc_id, text, max(toxic) FROM '{d}/documents.parquet' JOIN '{d}/labels.parquet' USING (doc_id) WHERE text IS NOT NULL GROUP BY ALL ORDER BY doc_id").fetchall()


def test_toxicity_against_a_loop(spark):
    """The query's verdicts are those of the model over each text; held out, it finds toxic rows and leaves clean ones alone."""
    d = "/root/testdata/sf0.01"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    model = toxicity.train(list(map(tuple, toxicity.sample(docs, labels).collect())))
    compress, codes = model.compressors(), toxicity.Codes()
    want = {r["doc_id"]: int(model.value(compress.gains(codes.of(r["text"]))) > model.threshold) for r in docs.collect()}
    got = toxicity.score(docs, labels).collect()
    assert {r["doc_id"]: r["predicted"] for r in got} == want and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)


def test_toxicity_held_out_and_in_long_texts():
    import random

    rows = _labelled("/root/testdata/sf0.1")
    out = lambda r: zlib.crc32(str(r[0]).encode()) % 5 == 0
    model, rnd = toxicity.train([r for r in rows if not out(r) and len(r[1]) <= toxicity.SAMPLE_BYTES]), random.Random(3)
    compress, codes = model.compressors(), toxicity.Codes()
    toxic = lambda t: model.value(compress.gains(codes.of(t))) > model.threshold
    found = [toxic(t) for d, t, k in rows if out((d,)) and k]
    wrong = [toxic(t) for d, t, k in rows if out((d,)) and not k]
    assert sum(found) >= 0.55 * len(found) and sum(wrong) <= 0.02 * len(wrong)
    clean = [t for d, t, k in rows if out((d,)) and not k and not toxic(t)]
    for size in (100_000, 1_000_000):
        text = ""
        while len(text) < size:
            text += rnd.choice(clean) + "\n"
        assert not toxic(text), size
    assert toxic(text[:100_000] + " stupid moron, worthless scum and pathetic loser")


def test_toxicity_sample_is_filtered_before_it_is_bounded(spark):
    docs = spark.createDataFrame([(k, "x " * 9000 if k % 2 else f"word {k}") for k in range(60)] + [(2, "another text")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k // 30) for k in range(60)] + [(1000, 1)], "doc_id long, toxic int")
    got = toxicity.sample(docs, labels, each=(8, 8)).collect()
    assert Counter(t for _, _, t in got) == {0: 8, 1: 8} and all(len(x) < 100 for _, x, _ in got)
