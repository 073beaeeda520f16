"""Fingerprints, URL filters and license scans."""

import datetime as dt
import functools
import hashlib
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from roadpulse.llm import fingerprints, licenses, url_filter

def plain_paragraphs(text):
    """The rule in plain Python: sentence ends and line breaks, long ones at words, long words at pairs of characters."""
    short = len(text) < fingerprints.SHORT
    long, cut = (fingerprints.SHORT_LONG, fingerprints.SHORT_CUT) if short else (fingerprints.LONG, fingerprints.CUT)

    def ends(*parts):
        found = functools.reduce(lambda seed, x: xxhash.xxh64_intdigest(x.encode(), seed), parts, 42)
        return (found - (found >> 63 << 64)) % cut == 0

    out = ""
    for sentence in re.split(fingerprints.PARAGRAPH_END, text):
        if len(sentence) > long:
            words = []
            for w in re.split(r"[ \t]+", sentence):
                if len(w) > long:
                    w = "".join(c + "\n" * ends(*([w[i - 1]] if i else []), c) for i, c in enumerate(w))
                words.append(w)
            sentence = "".join(w + ("\n" if ends(w) else " ") for w in words)
        out += sentence + "\n"
    return {p for p in re.split(" ?\n", out) if p}


def test_fingerprints(spark, documents, written):
    rng = random.Random(1)
    line = lambda: " ".join(rng.choice("abcdef") * rng.randint(1, 5) for _ in range(rng.choice([0, 2, 6, 60]))) + rng.choice([".", "", "é!"])
    rows = [(i * 3 + 1, "\n".join(line() for _ in range(rng.choice([0, 1, 4, 30])))) for i in range(150)]
    rows += [(7_000, None), (7_001, ""), (7_002, "same\n" * 50), (7_003, "same\n" * 50), (7_004, "\n".join(map(str, range(3_000)))), (7_005, "日本語文" * 90 + " x" * 300)]
    got = {r["doc_id"]: r for r in fingerprints.op7_fingerprints(spark, written(documents=documents(rows))).collect()}
    assert len(got) == len(rows)
    for k, (i, text) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        likeness = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        own, other, changed = map(plain_paragraphs, (text, following, edited))
        r = got[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r["near_edited"] - likeness(own, changed)) < 1e-12 and abs(r["near_next"] - likeness(own, other)) < 1e-12
    assert got[7_002]["fingerprint"] == got[7_003]["fingerprint"] and got[7_000]["fingerprint"] == got[7_001]["fingerprint"]


def test_sketches_alone_recover_the_difference(spark):
    """Without the comparison of digests that follows the last failure."""
    pairs = [(list(range(n)), list(range(n - d, 2 * n - d))) for n, d in ((5, 5), (40, 38), (40, 0), (300, 290), (1, 1))]
    df = spark.createDataFrame(pairs, "a array<long>, b array<long>")
    parts = F.greatest(F.lit(1), F.ceil((F.size("a") + F.size("b")) / 10).cast("int")) * 4
    got = df.select("a", "b", fingerprints._dealt(F.col("a"), F.col("b"), parts, F.lit(2)).alias("o")).collect()
    assert all(r["o"]["done"] for r in got)
    assert all((r["o"]["plus"], r["o"]["minus"]) == (len(set(r["a"]) - set(r["b"])), len(set(r["b"]) - set(r["a"]))) for r in got)


def test_peeling_gives_the_difference(spark):
    rng = random.Random(3)
    pairs = []
    for _ in range(200):
        own, both = ([rng.getrandbits(62) for _ in range(rng.randint(0, n))] for n in (6, 30))
        k = rng.randint(0, len(own))
        pairs.append((own[:k] + both, both[::-1] + own[k:]))
    df = spark.createDataFrame([([], [])] + pairs, "a array<long>, b array<long>")
    s = lambda c: fingerprints.sketch(F.col(c), F.lit(0))
    dealt = F.transform(fingerprints.hands(F.col("a"), F.col("b")), fingerprints._solved)
    got = df.select("a", "b", fingerprints.first_outcome(s("a"), s("b")).alias("o"), fingerprints._added(dealt).alias("all"))
    rows = got.collect()
    sides = [(len(set(r["a"]) - set(r["b"])), len(set(r["b"]) - set(r["a"]))) for r in rows]
    assert all((r["o"]["plus"], r["o"]["minus"]) == x for r, x in zip(rows, sides, strict=True) if r["o"]["done"])
    assert sum(r["o"]["done"] for r in rows) > 180
    assert all(r["all"]["done"] and (r["all"]["plus"], r["all"]["minus"]) == x for r, x in zip(rows, sides, strict=True))


def test_constants_are_worked_out_once(spark):
    df = spark.range(2).select(F.get(fingerprints._constants([None, 5, -7], "bigint"), F.col("id").cast("int")).alias("x"))
    assert [r["x"] for r in df.collect()] == [None, 5]
    assert "split(" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_paragraphs_with_odd_ends(spark):
    rng = random.Random(5)
    bits = ["a", "b", ".", "!", "?", "。", "！", "？", " ", "  ", "\t", "\n", "é", "日", "Word ", " \n", ".\n", ". "]
    texts = ["".join(rng.choices(bits, k=n)) for n in (0, 1, 2, 3, 8, 40, 90, 200, 700) for _ in range(30)]
    texts += ["a" * 300 + " ", "a" * 300 + "  \n b", " " * 500, "x. " * 200, "x。 " * 200, "é" * 130 + " " + "b " * 300]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fingerprints.paragraphs(F.col("t")).alias("p")).collect()
    assert all(set(r["p"]) == plain_paragraphs(r["t"]) for r in got)


def test_next_of_odd_tables(documents):
    assert fingerprints.compare_versions(documents([])).count() == 0
    one = fingerprints.compare_versions(documents([(5, "a\nb")])).collect()
    assert one[0]["near_next"] == 1.0
    rows = [(None, "n1"), (None, "n0"), (4, "x"), (4, "x"), (4, "w"), (9, "z")]
    got = fingerprints.with_next(documents(rows)).collect()
    assert sorted((str(r["doc_id"]), r["text"], r["next"]["text"]) for r in got) == sorted(
        [("None", "n0", "n1"), ("None", "n1", "w"), ("4", "w", "x"), ("4", "x", "x"), ("4", "x", "z"), ("9", "z", "n0")]
    )


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(n)


def test_url_filters_against_a_day_by_day_replay(spark):
    rng = random.Random(2)
    hosts = ["a.com", "www.a.com", "b.org", "x.y.b.org", "hot.net"]
    patterns = ["host:a.com", "domain:a.com", "domain:b.org", "path:hot.net/en", "path:hot.net/en/1", "domain:net", "host:hot.net"]
    entries = [(f"l{rng.randint(0, 1)}", rng.choice(patterns), rng.choice(["add", "remove"]), day(rng.randint(0, 700))) for _ in range(60)]
    urls = ["https://U:p@{}:80/en/1?q", "http://{}/en", "HTTP://{}", "ftp://{}/de/2#x"]
    pages = [(i, rng.choice(urls).format(rng.choice(hosts)), day(rng.randint(-5, 720))) for i in range(300)]
    pages += [(300 + i, "https://hot.net/en/1/2", day(i)) for i in range(700)]
    pages += [(2000, None, day(5)), (2001, "no url", day(5)), (2002, "https://hot.net/en", None), (None, "http://b.org", day(40)), (7, "http://b.org", day(9)), (7, "http://b.org", day(9))]
    junk = [(None, "host:a.com", "add", day(0)), ("l0", None, "add", day(0)), ("l0", "host:b.org", "add", None), ("l0", "host:b.org", "other", day(0))]
    spark_entries = spark.createDataFrame([*entries, *junk], "list string, pattern string, action string, entry_date date")
    spark_pages = spark.createDataFrame(pages, "page_id long, url string, fetched_on date").withColumn("host", F.lit("clash"))
    got = url_filter.judge(spark_pages, spark_entries).collect()
    latest = max(p[2] for p in pages if p[2])

    def keys(url):
        m = re.match(r"[A-Za-z]+://(?:[^/@]*@)?([^/:?#]*)[^/?#]*([^?#]*)", url or "")
        if not m or not m[1]:
            return None, set()
        host, seg = m[1].lower(), [s for s in m[2].split("/") if s]
        labels = host.split(".")
        found = {f"host:{host}"} | {"domain:" + ".".join(labels[i:]) for i in range(len(labels))}
        return host, found | {f"path:{host}/" + "/".join(seg[: i + 1]) for i in range(len(seg))}

    want = []
    for page, url, fetched in pages:
        host, mine = keys(url)
        active = set()
        for list_, pattern in {(e[0], e[1]) for e in entries if e[1] in mine}:
            events = sorted((e[3], e[2]) for e in entries if e[:2] == (list_, pattern) and e[3] <= (fetched or latest))
            if events and events[-1][1] == "add":
                active.add((list_, pattern))
        want.append((str(page), host, len(active), ",".join(sorted({a[0] for a in active})), bool(active)))
    assert sorted((str(r["page_id"]), r["host"], r["n_active"], r["lists"], r["blocked"]) for r in got) == sorted(want, key=str) or (
        sorted(map(str, ((str(r["page_id"]), r["host"], r["n_active"], r["lists"], r["blocked"]) for r in got))) == sorted(map(str, want))
    )
    assert url_filter.judge(spark_pages.limit(0), spark_entries).count() == 0
    assert not any(r["blocked"] for r in url_filter.judge(spark_pages, spark_entries.limit(0)).collect())


def test_paths_of_any_depth_match(spark):
    paths = ["/".join("abcdefgh"[:n]) for n in range(1, 9)]
    entries = spark.createDataFrame([(f"l{p.count('/')}", f"path:h.com/{p}", "add", day(0)) for p in paths], "list string, pattern string, action string, entry_date date")
    pages = [(n, f"https://h.com/{p}/page?q#x", day(n)) for n, p in enumerate(paths)] + [(20, "https://h.com/a/b/cd", day(1)), (21, "https://h.com/a//b/c", day(1))]
    got = {r["page_id"]: r["n_active"] for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, fetched_on date"), entries).collect()}
    assert got == {n: n + 1 for n in range(8)} | {20: 2, 21: 3}
    deep = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, fetched_on date"), entries.filter("list = 'l7'")).collect()
    assert [r["page_id"] for r in deep if r["blocked"]] == [7]


def test_spellings_of_patterns_and_hosts(spark):
    written = ["path:H.com/A/", "domain:Evil.org", " host:X.net. ", "path:h2.com//a//b", "PATH:h3.com", "domain:a.b/c", "odd:h.com", "host:", "", "path:h4.com/"]
    entries = spark.createDataFrame([("l", p, "add", day(0)) for p in written], "list string, pattern string, action string, entry_date date")
    kept = {r["pattern"] for r in url_filter.intervals(entries).collect()}
    assert kept == {"path:h.com/A", "domain:evil.org", "host:x.net", "path:h2.com/a/b", "host:h3.com", "host:h4.com"}
    urls = ["http://h.com/A/x", "http://h.com/a", "https://www.EVIL.org.", "http://evil.org./q", "ftp://x.net:80", "http://h2.com/a/b", "http://h3.com/z", "http://a.b/c", "http://.../"]
    pages = spark.createDataFrame([(i, u, day(1)) for i, u in enumerate(urls)], "page_id long, url string, fetched_on date")
    assert {r["page_id"] for r in url_filter.judge(pages, entries).collect() if r["blocked"]} == {0, 2, 3, 4, 5, 6}


def full_alignment(template, text):
    """Matching tokens of the best local alignment without a band."""
    best, above = (0, 0), [(0, 0)] * (len(text) + 1)
    for token in template:
        row = [(0, 0)]
        for j, other in enumerate(text):
            score, n = above[j]
            equal = token == other
            options = [(score + (2 if equal else -1), n + equal)] + [(s - 1, m) for s, m in (row[j], above[j + 1])]
            row.append(max(options) if max(options)[0] > 0 else (0, 0))
            best = max(best, row[-1])
        above = row
    return best[1]


def test_alignment_equals_the_full_one():
    rng = random.Random(3)
    for _ in range(150):
        template = np.array([rng.randint(0, 5) for _ in range(rng.randint(3, 14))])
        text = np.array([rng.randint(0, 5) for _ in range(rng.randint(0, 20))])
        assert licenses.align(template, text, -len(template), len(text))[0] == full_alignment(template, text)


def test_licenses_in_texts(documents):
    mit, bsd = licenses.TEMPLATES["mit"], licenses.TEMPLATES["bsd-3-clause"]
    edited = mit.replace("free of charge", "gratis").replace("Software", "program").upper()
    spaced = re.sub(" ", "\n   * ", bsd)
    rows = [
        (1, f"é intro\n{mit}\nend"), (2, edited), (3, spaced), (4, "all RIGHTS reserved! " * 3), (5, None), (6, ""),
        (7, "the rights of all"), (8, "word " * 60_000 + "Released under the MIT License." + " tail"), (9, mit + " x " + bsd),
        (9, mit + " x " + bsd),
    ]
    got: dict[int, list] = {}
    for r in licenses.scan_licenses(documents(rows)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    names = {i: sorted(r["license"] for r in found) for i, found in got.items()}
    assert names == {1: ["mit"], 2: ["mit"], 3: ["bsd-3-clause"], 4: ["all-rights-reserved"] * 3, 8: ["mit-line"], 9: ["bsd-3-clause"] * 2 + ["mit"] * 2}
    text, r = rows[0][1], got[1][0]
    assert r["coverage"] == 1.0 and text[r["span_start"] : r["span_end"]] == mit.rstrip(".")
    assert got[8][0]["span_start"] == 300_000 and 0.75 <= got[2][0]["coverage"] < 1
    assert licenses.scan_licenses(documents([])).count() == 0


def matches_of(text):
    index, data = licenses.Index(licenses.TEMPLATES), np.frombuffer(text.encode(), np.uint8)
    tokens, _, first, last = licenses.word_spans(data, np.array([0, len(data)]), licenses._BREAK)
    joined = licenses.joined_numbers(data, first, last)
    found = licenses.scan_tokens(tokens, list(index.hits(licenses.grams(tokens))), index, licenses.LEAST_COVERAGE, joined)
    return tokens, {index.names[m[0]]: m[2] for m in found}


def test_changes_of_many_tokens_inside_a_license():
    """As many matching tokens as full alignment finds, with 9 to 30 tokens put in or left out."""
    rng = random.Random(12)
    for name in ("mit", "bsd-3-clause", "apache-2.0"):
        words = re.findall(r"[A-Za-z0-9]+", licenses.TEMPLATES[name])
        template = licenses.tokens_of(licenses.TEMPLATES[name])
        for n in (9, 15, 20, 30, 41, 45):
            at = rng.randint(len(words) // 3, len(words) // 2)
            put = words[:at] + [f"header{i}" for i in range(n)] + words[at:]
            tokens, found = matches_of(" ".join(["before"] * 20 + put + ["behind"] * 20))
            assert found[name] == full_alignment(template, tokens) == len(template)
            if len(words) - n >= 0.76 * len(words):
                begin = len(words) // 3
                tokens, found = matches_of(" ".join(["before"] * 20 + words[:begin] + words[begin + n :] + ["behind"] * 20))
                assert found[name] == full_alignment(template, tokens)


def test_siblings_are_not_taken_for_each_other():
    gnu = "This work is licensed under the GNU {}General Public License, version {}."
    cases = {
        gnu.format("", 3): "gpl-3.0-line", gnu.format("", 2): "gpl-2.0-line", gnu.format("Affero ", 3): "agpl-3.0-line",
        gnu.format("Lesser ", 3): "lgpl-3.0-line", gnu.format("Lesser ", "2.1"): "lgpl-2.1-line", gnu.format("", 1): None,
        gnu.format("Affero ", 1): None, "Licensed under the Apache License, Version 2.0.": "apache-2.0-line",
        "Licensed under the Apache License, Version 1.1.": "apache-1.1-line", "Licensed under the Apache License, Version 1.0.": None,
        "Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0-line", "Licensed under CC BY-NC-SA 4.0.": "cc-by-nc-sa-4.0-line",
        "Licensed under CC BY 4.0.": "cc-by-4.0-line", "Licensed under CC BY-NC 3.0.": None, "Released under the ISC License.": None,
        licenses.TEMPLATES["mpl-2.0"].replace("2.0", "1.1"): None, gnu.format("", "3.1"): None, gnu.format("", "3.0"): "gpl-3.0-line",
        gnu.format("", "2.0.1"): None, gnu.format("Lesser ", "2.1.3"): None, gnu.format("", "3") + " 2020 Ann.": "gpl-3.0-line",
        "Licensed under the Apache License, Version 2.0.1.": None, "Licensed under the Apache License, Version 2.0.0": "apache-2.0-line",
        **{licenses.TEMPLATES[x]: x for x in ("gpl-2.0", "gpl-3.0", "lgpl-2.1", "lgpl-3.0", "agpl-3.0", "bsd-2-clause", "bsd-3-clause")},
    }
    for text, name in cases.items():
        assert list(matches_of(f"Some words before. {text} Some words behind.")[1]) == ([name] if name else []), text


def test_a_version_at_the_end_of_a_text_stands_apart_from_the_next_text(documents):
    apache, gpl = licenses.TEMPLATES["apache-2.0-line"], licenses.TEMPLATES["gpl-3.0-line"]
    # A final "2.0." is followed by the next text's digits, a final "3" by its dot and digits.
    texts = [apache, "7 and so on", "", gpl[:-1], ".5 of it", apache, "", "1", "words only", gpl, "2" + apache, apache]
    docs = documents(list(enumerate(texts))).coalesce(1).sortWithinPartitions("doc_id")
    got = {r["doc_id"]: r["license"] for r in licenses.scan_licenses(docs).collect()}
    want = {0: "apache-2.0-line", 3: "gpl-3.0-line", 5: "apache-2.0-line", 9: "gpl-3.0-line", 10: "apache-2.0-line", 11: "apache-2.0-line"}
    assert got == want


def test_versions_of_many_numbers(documents):
    text = licenses.TEMPLATES["apache-2.0-line"][:-1]
    docs = documents([(1, text + ".0" * 5000 + "."), (2, text + ".0" * 5000 + ".1.")])
    assert [(r["doc_id"], r["license"]) for r in licenses.scan_licenses(docs).collect()] == [(1, "apache-2.0-line")]


def test_shared_runs_are_always_found():
    """Any GRAM + WINDOW - 1 tokens in a row share a fingerprint with their template."""
    index = licenses.Index(licenses.TEMPLATES)
    for t, tokens in enumerate(index.tokens):
        n = licenses.GRAM + licenses.WINDOW - 1
        for begin in range(len(tokens) - n + 1):
            assert any(hit[1] == t for hit in index.hits(licenses.grams(tokens[begin : begin + n])))


def test_paragraphs_move_with_their_text(spark):
    """Something put before a text, or half of it replaced, leaves the paragraphs of the rest as they are."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 9)))
    sentence = lambda n: " ".join(word() for _ in range(n)) + "."
    lines = [" ".join(sentence(rng.randint(4, 60)) for _ in range(30)), " ".join(word() for _ in range(600)), "".join(rng.choices("日本語文章未", k=3_000))]
    short = [sentence(22) for _ in range(20)]
    rows = [(t, "X" + t, t[: len(t) // 2] + word() * 5) for t in lines + short] + [("One. Two!  three\n\nfour", "three", "four\nOne.")]
    found = lambda c: F.transform(fingerprints.paragraphs(F.col(c)), lambda p: F.xxhash64(p)).alias(c)
    df = spark.createDataFrame(rows, "a string, moved string, halved string")
    got = [[set(x) for x in r] for r in df.select(*map(found, df.columns)).collect()]
    likeness = lambda a, b: len(a & b) / len(a | b)
    assert all(likeness(a, moved) > 0.9 for a, moved, _ in got[:3]) and all(a & halved for a, _, halved in got[:-1])
    assert len(got[-1][0]) == 4 and len(got[-1][0] & got[-1][1]) == 1 and len(got[-1][0] & got[-1][2]) == 2
