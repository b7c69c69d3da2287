"""The training-data operators against brute-force versions in plain Python, on data where their methods act."""

import json
import math
import random
from collections import Counter, defaultdict
from pathlib import Path

import pytest
import regex
from pyspark.sql import functions as F

from lodestar.llm import chat, decontaminate, jaccard, licenses, mixing, pii, quality, sharding, urls
from lodestar.llm.common import table

WORDS = regex.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _copy int, _key string, _source string, _epoch int, _cut string, _row string, _nth int, `a.b` int"


def shingles(t):
    w = WORDS.findall(t or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def classes(rows):
    """rows: (doc_id, text). Of each row its class's number and its links, by all pairs of distinct sets that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    kinds = {s: k for k, s in enumerate(dict.fromkeys(s for s in sets if s))}
    own, n = list(kinds), Counter(sets)
    root, links = list(range(len(own))), Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for k, s in enumerate(own):
        for x in s:
            holders[x].append(k)
    for k, s in enumerate(own):
        for j, both in Counter(j for x in s for j in holders[x] if j < k).items():
            if both >= 0.8 * (len(s) + len(own[j]) - both):
                links[k] += n[own[j]]
                links[j] += n[s]
                x, y = sorted((find(k), find(j)))
                root[y] = x
    return [(find(kinds[s]), links[kinds[s]] + n[s] - 1) if s else (None, 0) for s in sets]


def check_join(spark, rows):
    got = Counter(tuple(r) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "class_id", "n_links").collect())
    found = classes(rows)
    least = {}
    for (d, _), (c, _) in zip(rows, found, strict=True):
        least[c] = min((x for x in (least.get(c), d) if x is not None), default=None)
    assert got == Counter((d, d if c is None else least[c], n) for (d, _), (c, n) in zip(rows, found, strict=True))


def test_jaccard_at_sf001(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, "/root/testdata/sf0.01", "documents").collect()]
    check_join(spark, rows)


def test_jaccard_of_shared_and_missing_ids(spark):
    base = [f"w{i}" for i in range(60)]
    near = lambda *at: " ".join("x" if k in at else w for k, w in enumerate(base))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(1, other), (1, near()), (3, near(59)), (None, near(0)), (None, near(0)), (None, other + " z"), (7, "alone in here and nothing else"), (8, None), (8, " \n"), (1, other)]
    check_join(spark, rows)
    docs = spark.createDataFrame([(d, t, k) for k, (d, t) in enumerate(rows)], "doc_id long, text string, n int")
    kept = [(r["doc_id"], r["text"]) for r in jaccard.one_of_each(docs).collect()]
    assert Counter(kept) == Counter([(1, other), (1, near()), (7, rows[6][1]), (8, None), (8, " \n")])


def test_jaccard_recall_at_the_threshold(spark):
    """Isolated pairs of 0.8 to 0.82: none that only the last level may find is lost."""
    rnd, rows, pairs = random.Random(9), [], 0
    while pairs < 1500:
        w = [f"{pairs}x{i}" for i in range(rnd.randrange(40, 120))]
        cut = rnd.randrange(1, len(w) // 4)
        a, b = shingles(" ".join(w)), shingles(" ".join(w[cut:]))
        if 0.8 <= len(a & b) / len(a | b) <= 0.82:
            rows += [(2 * pairs, " ".join(w)), (2 * pairs + 1, " ".join(w[cut:]))]
            pairs += 1
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["n_links"] == 1 and r["class_id"] == r["doc_id"] // 2 * 2 for r in got)


@pytest.fixture(scope="module")
def repeats(spark):
    """Repeated rows, rows without ids or sources, and columns with the names of internal ones."""
    rows = [(None, f"text {k % 7} of some words", "en", "a" if k % 3 else None, 1, 5, "k", "s", 6, "c", "r", 7, 8) for k in range(600)]
    rows += [(k, "one two three four five " * (1 + k % 4), "en", "b", 1, 5, "k", "s", 6, "c", "r", 7, 8) for k in range(300)]
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("how", [{"budget_tokens": 2000}, {"max_repeats": None, "entropy_share": 0.98}])
def test_mixed_rows_agree_with_the_schedule(spark, repeats, how):
    times = lambda df: Counter((r["doc_id"], r["source"]) for r in df.collect())
    rows = mixing.mixed_rows(repeats, **how)
    assert rows.columns == repeats.columns and times(mixing.mix(repeats, block_tokens=500, **how)) == times(rows)
    assert {tuple(r)[5:] for r in rows.collect()} == {tuple(r)[5:] for r in repeats.collect()}


def test_mixing_of_many_sources(spark):
    docs = spark.range(100_001).select(F.col("id").alias("doc_id"), F.lit("one two").alias("text"), F.col("id").cast("string").alias("source"))
    assert mixing.mixed_rows(docs).count() == mixing.mix(docs).count() == 100_001


def test_sharded_rows_agree_with_the_shards(spark, repeats):
    for n in (10,):
        want = Counter((r["doc_id"], r["text_crc32"], r["shard"]) for r in sharding.shard(repeats, n).collect())
        rows = sharding.sharded_rows(repeats, n)
        assert rows.columns == [*repeats.columns, "shard"]
        got = Counter((r["doc_id"], r["c"], r["shard"]) for r in rows.select("doc_id", F.crc32(F.col("text").cast("binary")).alias("c"), "shard").collect())
        assert got == want
    rows = sharding.shard(repeats, 10).collect()
    total, largest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    by = Counter()
    for r in rows:
        by[r["shard"]] += r["size"]
    assert all(abs(n - total / 10) <= largest for n in by.values()) and len(by) == 10


def template(text):
    """The hashed forms of a text's words: core in capitals, kind of placeholder."""
    t = regex.sub(r"[^\p{L}\p{N}\x20\x09-\x0D.,!?:;]+", "", text or "")
    t = regex.sub(r"[\x20\x09-\x0D]+([.,!?:;])", r"\1", t)
    w = WORDS.findall(t)
    core, kinds = [x.strip(".,!?:;") for x in w], []
    digit = lambda c: "0" <= c < ":"
    for i, c in enumerate(core):
        kind = None
        if digit(c):
            kind = "<number>" if regex.match(r"^[0-9][0-9.,]*$", c) else None
        elif i and digit(core[i - 1]):
            kind = "<unit>" if c.lower() in decontaminate.UNITS else None
        elif ("A" <= c < "[" or c >= "\u0080" and c[0] != c[0].lower()) and i and w[i - 1][-1] not in ".!?:":
            kind = "<name>"
        kinds.append(kind)
    return [c.upper() for c in core], kinds


def leaks(text, item, windows={}):  # noqa: B006
    """Whether text holds item, by all places of both."""
    if item not in windows:
        windows[item] = list(spans(item))
    size, templates = len({at for at, *_ in windows[item]}), sum(k == "t" for _, k, *_ in windows[item])
    if not size:
        return False
    at_hash = defaultdict(list)
    for at, kind, form, values in windows[item]:
        at_hash[form].append((at, kind, values))
    diagonals = defaultdict(list)
    for at, kind, form, values in spans(text):
        for item_at, item_kind, item_values in at_hash.get(form, ()):
            diagonals[at - item_at].append((item_at, kind == item_kind == "t", [(a, b) for a, b in zip(item_values, values, strict=True) if a] if any(item_values) and any(values) else []))
    enough = lambda n: min(math.ceil(n * decontaminate.SHARE), decontaminate.RUN - decontaminate.WINDOW + 1)
    for hits in diagonals.values():
        for some, all_of in ((hits, size), ([h for h in hits if h[1]], templates)):
            slots = {x for *_, s in some for x in s}
            fits = len({a for a, _ in slots}) == len(slots) == len({b for _, b in slots})
            if some and len({h[0] for h in some}) >= enough(all_of) and fits:
                return True
    return False


def spans(text):
    """(place, kind, form, values) of the windows."""
    core, kinds = template(text)
    size, few = decontaminate.WINDOW, decontaminate.WINDOW - decontaminate.PLAIN
    for at in range(len(core) - size + 1):
        c, k = core[at : at + size], kinds[at : at + size]
        blind = [None if x == "<name>" else x for x in k]
        form = lambda slots, c=c: tuple(x or y for x, y in zip(slots, c, strict=True))
        value = lambda slots, c=c: [y if x else None for x, y in zip(slots, c, strict=True)]
        n, m = sum(map(bool, k)), sum(map(bool, blind))
        if n <= few:
            yield at, "t", form(k), value(k)
        if m <= few and n > m:
            yield at, "b", form(blind), value(blind)
        if m > few:
            yield at, "l", tuple(c), [None] * size


def test_decontamination_both_ways(spark):
    """Every leak of the brute force, and nothing else: planted passages, other numbers, torn slots, and the documents as they are."""
    rnd = random.Random(4)
    bench = [(r["item_id"], r["text"]) for r in table(spark, "/root/testdata/sf0.01", "benchmark").collect()]
    bench += [(1001, "A train leaves Springfield with 120 passengers and travels 300 km before Alice and another 120 people leave it at noon"), (1002, "Short item of five words"), (1003, None)]
    docs = [(r["doc_id"], r["text"]) for r in table(spark, "/root/testdata/sf0.01", "documents").limit(250).collect()]
    for k in range(150):
        w = (rnd.choice(bench[:-1])[1]).split()
        form = rnd.choice([str, str.upper, str.title])
        cut = rnd.randrange(len(w)) if rnd.random() < 0.6 else 0
        w = [str(rnd.randrange(90)) if x.isdigit() and rnd.random() < 0.5 else "swapped" if rnd.random() < 0.03 else x for x in w]
        docs.append((10_000 + k, "Some words before. " + form(" ".join(w[cut : cut + rnd.randrange(8, 60)])) + "\nand after"))
    docs += [(20_000, "Intro\nSHORT item, of five words!\nmore"), (20_001, "a Short item of five words in a line")]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert got == {(d, i) for d, t in docs for i, x in bench if leaks(t, x or "")} | {(20_000, 1002)} and len(got) > 60


def linked(messages):
    """The rows of format_chat without json, by a walk over each conversation."""
    out, calls, results = [], [], []
    for conv, turn, role, text in messages:
        try:
            v = json.loads(text) if text and text.startswith("{") else None
        except ValueError:
            v = None
        if role == "assistant" and v and v.get("tool_calls"):
            if v.get("content"):
                out.append((conv, turn, -1, 0, "message", None, "none", True))
            calls += [(conv, turn, part, c) for part, c in enumerate(v["tool_calls"])]
        elif role == "tool" and v and v.get("tool_call_id") is not None:
            results.append((conv, turn, v["tool_call_id"], v.get("content")))
        else:
            out.append((conv, turn, 0, 0, "message", None, "none", True))
    first, first_result = {}, {}
    key = lambda t, p, c: (t, p, c["name"], c["arguments"])
    for conv, turn, part, c in calls:
        if c["id"] is not None:
            first[conv, c["id"]] = min(first.get((conv, c["id"]), (key(turn, part, c), c, turn, part)), (key(turn, part, c), c, turn, part), key=lambda x: x[0])
    for conv, turn, i, content in results:
        first_result[conv, i] = min(first_result.get((conv, i), (turn, content)), (turn, content))
    level = {}
    while True:
        new = {}
        for (conv, i), (_, c, turn, _) in first.items():
            deps = c.get("depends_on") or []
            if (conv, i) not in level and all((conv, d) in level for d in deps):
                new[conv, i] = (1 + max((level[conv, d][0] for d in deps), default=-1), max([turn, *(level[conv, d][1] for d in deps)]))
        if not new:
            break
        level |= new
    for conv, turn, part, c in calls:
        i = (conv, c["id"])
        a = json.loads(c["arguments"])
        good = c["name"] == "search" and isinstance(a.get("query"), str) and not set(a) - {"query", "limit"} and isinstance(a.get("limit", 1), int)
        if c["id"] is None:
            out.append((conv, turn, 0, part, "call", None, "pending", False))
            continue
        at = level.get(i, (-1, first[i][2]))
        status = "duplicate" if first[i][0] != key(turn, part, c) else "linked" if i in first_result else "pending"
        out.append((conv, at[1], 2 * max(at[0], 0), part, "call", c["id"], status, good and at[0] >= 0))
    for conv, turn, i, content in results:
        if (conv, i) not in first:
            out.append((conv, turn, 0, 0, "result", i, "orphan", False))
            continue
        at = level.get((conv, i), (-1, first[conv, i][2]))
        out.append((conv, at[1], 2 * max(at[0], 0) + 1, first[conv, i][3], "result", i, "linked" if first_result[conv, i] == (turn, content) else "duplicate", True))
    return Counter(out)


def conversations(seed):
    rnd, rows = random.Random(seed), []
    for conv in [*range(25), None]:
        ids = [f"c{k}" for k in range(rnd.randrange(1, 9))]
        for turn in range(rnd.randrange(1, 12)):
            kind = rnd.random()
            if kind < 0.45:
                made = [{"id": rnd.choice([*ids, None]), "name": rnd.choice(["search", "nobody"]), "arguments": json.dumps(rnd.choice([{"query": "x"}, {"query": 5}, {"query": "y", "limit": 3}, {"limit": 1}, {"query": "x", "more": 1}])), "depends_on": rnd.sample([*ids, "gone"], rnd.choice([0, 0, 1, 1, 2]) if len(ids) > 1 else 0)} for _ in range(rnd.randrange(1, 4))]
                rows.append((conv, turn, "assistant", json.dumps({"content": rnd.choice(["", "Let me see"]), "tool_calls": made})))
            elif kind < 0.75:
                rows.append((conv, turn, "tool", json.dumps({"tool_call_id": rnd.choice([*ids, "gone"]), "content": rnd.choice("789")})))
            else:
                rows.append((conv, turn, rnd.choice(["user", "assistant", None]), rnd.choice(["hi", "", None, "{broken", '{"a":1}'])))
    chain = [{"id": f"k{n}", "name": "search", "arguments": '{"query":"x"}', "depends_on": [f"k{n + 1}"] if n < 7 else []} for n in range(8)]
    return rows + [(99, n, "assistant", json.dumps({"tool_calls": [c]})) for n, c in enumerate(chain)] + rows[:10] * (seed % 2)


@pytest.mark.parametrize("seed", [1])
def test_tool_calls_against_a_walk(spark, seed):
    rows = conversations(seed)
    got = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("status", F.lit("x"))).collect()
    assert Counter(tuple(r)[:8] for r in got) == linked(rows)
    assert all(r["json"] == json.dumps(json.loads(r["json"]), sort_keys=True, separators=(",", ":"), ensure_ascii=False) for r in got)


def test_chat_of_no_rows_and_long_texts(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert chat.format_chat(spark.createDataFrame([], schema)).count() == 0
    long = json.dumps({"content": "y" * 200_000, "tool_calls": [{"id": "a", "name": "search", "arguments": json.dumps({"query": "z" * 200_000})}]})
    got = {r["kind"]: len(r["json"]) for r in chat.format_chat(spark.createDataFrame([(1, 0, "assistant", long), (1, 1, "user", "w" * 300_000)], schema)).collect()}
    assert got["call"] > 200_000 and got["message"] > 200_000


def tail(n, k, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) if k < n * p else 1.0


def test_quality_steps_against_brute_force(spark):
    rnd, rows = random.Random(3), []
    for k in range(3000):
        bad = rnd.random() < 0.08
        text = " ".join(f"w{rnd.randrange(10**6)}" + ("#" if rnd.random() < (0.9 if bad else 0.02) else "") + ("!" if rnd.random() < 0.1 else "") for _ in range(30))
        rows.append((k, text, rnd.choice(["en", "de", None, "xx"]) if k % 51 else "rare", int(not bad)))
    rows += [(5000 + k, rows[k][1], rows[k][2], rows[k][3]) for k in range(200)]
    docs, labels = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string"), spark.createDataFrame([(r[0], r[3]) for r in rows if r[0] % 2], "doc_id long, quality int")
    stats = {r["doc_id"]: r for r in quality.statistics(docs).collect()}
    step = lambda r: next((j for j, (rule, c) in enumerate(quality.PATH, 1) if r[quality.RULES[rule][0]] > c * r[quality.RULES[rule][1]]), 99)
    held = defaultdict(dict)
    for d, text, lang, good in rows:
        if good and d % 2:
            held[lang][text] = step(stats[d])
    last = {}
    for lang, steps in held.items():
        last[lang] = 0
        while last[lang] < len(quality.PATH) and tail(len(steps), sum(s <= last[lang] + 1 for s in steps.values()), 0.05) <= 0.05 / len(held):
            last[lang] += 1
    want = {d: step(stats[d]) > last[lang] for d, _, lang, _ in rows}
    assert {r["doc_id"]: r["kept"] for r in quality.judge(docs, labels).collect()} == want
    assert 150 < sum(not x for x in want.values()) < 400 and last["rare"] == 0 < last["en"]


def test_quality_of_ten_thousand_and_one_strata(spark):
    docs = spark.range(300_030).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b c d e f g h i j k l m "), F.col("id").cast("string")).alias("text"), (F.col("id") % 10_001).cast("string").alias("lang"))
    bad = docs.where("doc_id < 10001").withColumns({"doc_id": F.col("doc_id") + 10**6, "text": F.lit("# $ % & * # $ % & * #")})
    judged = quality.judge(docs.unionByName(bad), docs.select("doc_id", F.lit(1).alias("quality")), limit=0.5)
    assert judged.where("not kept").count() == 10_001


def test_secrets_whole_and_cues_in_any_case(spark):
    long = "k" * 5000
    texts = [f"token = {long}", "API key: abcdefghijklmnopqrst", "aPi_KeY=abcdefghijklmnopqrst", "İİ Token: abcdefghijklmnopqrst"]
    got = [(r["spans"], r["n_secret"]) for r in pii.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == [("secret:8:5008", 1), ("secret:9:29", 1), ("secret:8:28", 1), ("secret:10:30", 1)]


def test_licence_files_as_they_are_distributed(spark):
    t = licenses.TEXTS
    texts = [
        (1, "MIT License\n\nCopyright (c) 2020 Some One\n\n" + t["MIT"], "MIT"),
        (2, "The MIT License (MIT)\n\nCopyright © 2011-2014 A, B\n\n" + t["MIT"].replace("\n", "\n\n"), "MIT"),
        (3, "BSD 3-Clause License\n\nCopyright (c) 2017, X\nAll rights reserved.\n\n" + t["BSD-3-Clause"].replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* "), "BSD-3-Clause"),
        (4, "/* " + t["ISC"].replace("\n", "\n * ") + " */", "ISC"),
        (5, t["BSD-2-Clause"].replace("copyright holder", "copyright owner").upper(), "BSD-2-Clause"),
        (6, t["MIT"] + " And one condition more.", None),
        (7, "This is free and unencumbered", None),
        (8, t["Unlicense"].replace("https", "http").replace("non-commercial", "noncommercial"), "Unlicense"),
    ]
    got = {r["doc_id"]: r["license"] for r in licenses.scan(spark.createDataFrame([x[:2] for x in texts], "doc_id long, text string")).collect()}
    assert got == {k: v for k, _, v in texts}
    known = spark.createDataFrame([(r["digest"], "own") for r in licenses.scan(spark.createDataFrame([(6, texts[5][1])], "doc_id long, text string")).collect()], "digest string, license string")
    assert licenses.scan(spark.createDataFrame([(6, texts[5][1])], "doc_id long, text string"), digests=known).first()["license"] == "own"


FOLDER = Path("/usr/share/common-licenses")


@pytest.mark.skipif(not FOLDER.exists(), reason="no licence files here")
def test_long_licences_by_digest(spark):
    """Files of the system's own folder, as they are and with other line breaks and capitals."""
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "GFDL-1.3": "GFDL-1.3"}
    rows, want = [], {}
    for name, spdx in names.items():
        if (FOLDER / name).exists():
            text = (FOLDER / name).read_text(encoding="utf-8")
            rows += [(2 * len(want), text), (2 * len(want) + 1, text.upper().replace("\n\n", "\n\n\n"))]
            want[len(want)] = spdx
    got = {r["doc_id"]: r["license"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: want[k // 2] for k in range(2 * len(want))}


def test_a_thousand_url_rules(spark):
    """An index over a thousand rules of a table gives the verdicts of running all of them."""
    import re

    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcde") for _ in range(3))
    forms = [lambda: rf"/{word()}(?:\.[a-z]+)?/?\Z", lambda: rf"\A[^/]*\b{word()}-{word()}\b", lambda: rf"/{word()}/(?:{word()}|{word()})/", lambda: rf"\b{word()}\b[^/]*/{word()}/"]
    table_rows = [("pattern", rnd.choice(["allow", "block"]), rnd.choice(forms)()) for _ in range(900)] + [("scope", rnd.choice(["allow", "block"]), f"{word()}.com/{word()}") for _ in range(100)]
    rules = urls.rules_of(spark.createDataFrame(table_rows, "kind string, action string, rule string"))
    rows = [(k, f"http://{word()}.{rnd.choice(['com', 'net'])}/{word()}{rnd.choice(['', '/', '.html', '/' + word() + '/'])}") for k in range(300)] + [(400, "http://aaa.com/" + "abc/" * 300), (401, rows_url := "http://aaa.com/abc/"), (401, rows_url)]
    pages = spark.createDataFrame([(*r, "rule", "verdict") for r in rows], "page_id long, url string, rule string, token string")
    got = Counter((r["page_id"], r["rule"], r["verdict"]) for r in urls.judge(pages, rules).collect())
    want = Counter()
    for k, u in rows:
        fits = [r for r in rules if re.search(r.pattern, u[7:])]
        scope = max((r for r in fits if r.scope), key=lambda r: len(r.scope), default=None)
        actions = {r.action for r in fits if not r.scope}
        want[k, scope and scope.scope, scope.action if scope else "allow" if "allow" in actions or not actions else "block"] += 1
    assert got == want and len({v for _, _, v in got}) == 2
