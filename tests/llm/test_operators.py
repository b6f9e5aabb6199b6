"""The ten operators against brute force and on awkward inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm import bpe, exact_dedup, line_dedup, mixing, ngram_join, ppm, quality, registry, substring_dedup, url_filter, warc
from sparkloom.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
AWKWARD = [
    (1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "en", "a", 1),
    (2, None, None, None, 2),
    (3, "", "en", "a", 3),
    (4, "ONE two  three\nfour five six seven eight nine ten eleven twelve thirteen fourteen", "en", "b", 4),
    (4, "ONE two  three\nfour five six seven eight nine ten eleven twelve thirteen fourteen", "en", "b", 4),
    (5, "word " * 30000, "fr", "a", 5),
    (None, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "en", None, 6),
    (7, "x", "de", "c", 7),
    (8, " \t\n ", "de", "c", 8),
    (9, "é ö <|endoftext|> don't #$%", "de", "c", 9),
]
#: The last columns clash with names that operators use inside.
CLASH = "doc_id long, text string, lang string, source string, size long, sid string, doc string, key int, tokens string, kept int, row string, line string"


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(*r, "s", "d", 1, "t", 0, "r", "l") for r in AWKWARD], CLASH)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], CLASH)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def jaccard_components(texts):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {(i, len(sets[i]), find(i)) for i in sets}


def test_components_of_paths_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(500, k) for k in range(501, 560)] + [(7, 7), (3, None), (559, 100)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {k: 100 for k in [*range(100, 141), *range(500, 560)]}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_exact_dedup(docs, texts, awkward, empty):
    groups = defaultdict(list)
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in texts.items()}
    for i, t in norm.items():
        groups[t].append(i)
    want = {(i, min(groups[t]), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm.items()}
    assert {tuple(r) for r in exact_dedup.exact_duplicates(docs, hash_all=True).collect()} == want
    # A crowded filter lets more rows through and changes nothing.
    few = exact_dedup.exact_duplicates(docs, hash_all=True, filter_bits=64)
    assert {tuple(r) for r in few.collect()} == want
    rows = exact_dedup.exact_duplicates(awkward).collect()
    assert len(rows) == len(AWKWARD)
    assert {r.keep_id for r in rows if r.doc_id in (2, 3)} == {2}
    assert [r.group_size for r in rows if r.doc_id == 4] == [2, 2]
    assert [(r.keep_id, r.kept) for r in rows if r.doc_id is None] == [(1, False)]
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_url_filter(spark, sf_dir):
    pages = [
        (1, "http://a.example.org/x", "<link rel='canonical' href='http://b.example.net/y'>"),
        (2, "http://b.example.net/y", None),
        (3, "https://c.example.org/z?utm_source=q#top", '<meta http-equiv="refresh" content="0; url=/z2">'),
        (4, "https://c.example.org/z2", "<p>"),
        (5, None, None),
        (6, "no scheme", "x"),
        (7, "http://EXAMPLE.net/en/1", None),
        (8, "http://d.example.com/q", '<link href="http://example.net/en/1" rel="canonical"><link rel="canonical" href="http://x.net/">'),
        (9, "http://x.net/", None),
        (9, "http://x.net/", None),
        (10, "http://e.example.com/q", None),
    ]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    redirects = spark.createDataFrame([("http://e.example.com/q", "http://d.example.com/q"), ("http://d.example.com/q", "http://x.net/")], "src string, dst string")
    got = {r.page_id: r for r in url_filter.filter_urls(frame, url_filter.RULES, redirects).collect()}
    assert (got[2].rule, got[2].verdict) == ("net/", "block")
    assert (got[1].rule, got[1].verdict) == (None, "block")  # canonical target is blocked
    assert got[3].verdict == got[4].verdict == "allow"
    assert (got[5].host, got[5].path, got[5].verdict) == ("", "", "allow") and got[6].host == ""
    assert (got[7].host, got[7].rule, got[7].verdict) == ("example.net", "example.net/en/", "allow")
    assert got[8].verdict == got[10].verdict == "allow"  # allow goes before the block of x.net
    assert got[9].verdict == "block"
    assert url_filter.filter_urls(frame, url_filter.RULES).count() == len(pages)
    assert url_filter.filter_urls(frame.limit(0), url_filter.RULES).count() == 0


def test_links_are_resolved(spark):
    from urllib.parse import urldefrag, urljoin

    pages = ["http://a.org/x/y/z.html?q=1#top", "https://b.net", "http://c.com/d/"]
    hrefs = ["http://e.org/f", "//g.org/h?i", "/j/../k", "l.html", "./m", "../n/", "../../../o", "?p=1", "q?r=/s", "t/./u/..", "v&amp;w", "#x", "mailto:y@z.org", ""]
    rows = [(u, h) for u in pages for h in hrefs]
    frame = spark.createDataFrame(rows, "url string, href string").select("url", "href", url_filter.resolved(F.col("url"), F.col("href")).alias("target"))
    for r in frame.collect():
        if r.href in ("", "#x", "mailto:y@z.org"):
            assert r.target is None
        else:
            assert r.target == urldefrag(urljoin(r.url, r.href.replace("&amp;", "&")))[0], (r.url, r.href)


def test_url_filter_against_brute_force(spark):
    """Unquoted and relative links, ties of rules, very long urls and pages, clashing columns."""
    import random

    rnd = random.Random(11)
    urls = [f"http://h{k}.{d}/p/{k}.html" for k in range(40) for d in ("net", "org", "com")]
    urls += ["http://example.net/en/" + "x" * 20_000, "http://q.org/fr/" + "y/" * 3000]
    pages = []
    for k, u in enumerate(urls):
        to = rnd.choice(urls)
        quote = rnd.choice(['"', "'", ""])
        html = rnd.choice(["", f"<LINK Rel={quote}canonical{quote} hreflang=en HREF={quote}{to}{quote}>", f"<meta content=\"3; URL={to}\" http-equiv=refresh>", "z" * 200_000])
        pages.append((k, u, html, "clash", k))
    frame = spark.createDataFrame(pages, "page_id long, url string, html string, host string, component long")
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    def rule(u):
        host, path = re.match(r"https?://([^/?#]*)([^?#]*)", u).groups()
        fits = [(len(r), r, a) for a, r in url_filter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        return max(fits)[1:] if fits else (None, None)

    for _, u, html, *_ in pages:
        canon = "https://" + re.sub(r"(\.html|/)$", "", u.split("://")[1])
        for v in [canon, *re.findall(r"(?i)(?:href=|url=)[\"']?([^\"'>]+)", html)]:
            root[find(u)] = find(v)
    flags = defaultdict(set)
    for u in list(root):
        flags[find(u)].add(rule(u)[1])
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(frame, url_filter.RULES).collect()}
    for k, u, *_ in pages:
        name, action = rule(u)
        inherited = "allow" if "allow" in flags[find(u)] or "block" not in flags[find(u)] else "block"
        assert got[k] == (name, action or inherited), u


def test_quality(docs, texts, awkward, empty, sf_dir):
    got = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    for i, t in texts.items():
        w = WORD.findall(t or "")
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert not (r.base_failed and r.kept)
    clean = {r.doc_id for r in docs.sparkSession.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1 and toxic = 0").collect()}
    passed = [i for i in clean if not got[i].base_failed]
    assert sum(got[i].kept for i in passed) >= 0.97 * len(passed)
    rows = quality.quality_rules(awkward).collect()
    assert len(rows) == len(AWKWARD) and {r.n_words for r in rows if r.doc_id in (2, 3, 8)} == {0}
    assert [r.n_repeat_words for r in rows if r.doc_id == 5] == [30000]
    assert quality.quality_rules(empty).count() == 0


def brute_limits(rows, groups=("lang", "source"), min_rows=quality.MIN_ROWS):
    """Limits of each (group, metric) by sorting each group's values."""
    levels = [defaultdict(list) for _ in range(3)]
    for key, values in rows:
        for k in range(3):
            levels[k][key[:k]].append(values)

    def sketched(v):
        return 0.0 if v < 1 else quality.GAMMA ** math.ceil(math.log(v) / math.log(quality.GAMMA))

    out = {}
    for key in levels[2]:
        for m, (spread, constant) in quality.METRICS.items():
            parts = []
            for k in range(3):
                held = sorted(v[m] for v in levels[k][key[:k]])
                p10, p50, p90 = (sketched(held[math.ceil(len(held) * q) - 1]) for q in (quality.LOW, 0.5, quality.HIGH))
                parts.append((p50, p90 - p50, p50 - p10) if k == 0 or len(held) >= min_rows else None)
            found = None
            for k, part in enumerate(parts):
                if part is None:
                    continue
                reach = []
                for side in (1, 1 if m in quality.BASE_RULED else 2):
                    width = max(p[side] for p in parts[: k + 1] if p)
                    limit = part[0] + spread * width if width > 0 else max(float(constant), part[0])
                    reach.append(min(limit, 1000.0) if m in quality.SHARES else limit)
                found = min(reach) if k == 0 else min(reach[0], max(reach[1], found))
            out[key, m] = found
    return out


@pytest.mark.parametrize("min_rows", [quality.MIN_ROWS, 5])
def test_quality_limits_against_brute_force(spark, docs, min_rows):
    measured = quality.signals(docs)
    rows = [((r.g0, r.g1), {m: r[m] for m in quality.METRICS}) for r in measured.select("g0", "g1", *[v.alias(m) for m, v in quality._per_mille().items()]).collect()]
    want = brute_limits(rows, min_rows=min_rows)
    found = quality.limits(measured, ["g0", "g1"], min_rows).collect()
    got = {((r.g0, r.g1), m): r[f"limit_{m}"] for r in found for m in quality.METRICS}
    assert got == pytest.approx(want)
    assert all(got[key, m] <= 1000 for key, m in got if m in quality.SHARES)
    # Where a group or a wider one has spread, its limit is its own and no constant: in all groups for word size and repeats.
    own = Counter(m for (_, m), v in got.items() if v != quality.METRICS[m][1])
    assert own["word_size"] == own["repeats"] == len(found)
    assert min_rows > 5 or len({v for (_, m), v in got.items() if m == "word_size"}) >= 4


def brute_ppm(train, texts, order):
    """Method C with exclusion, contexts in plain dictionaries."""
    table = defaultdict(Counter)
    pad = (0,) * order

    def symbols(t):
        return pad + tuple(t) + (ppm.END,)

    for t in train:
        s = symbols(t)
        for k in range(order, len(s)):
            for d in range(order + 1):
                table[s[k - d : k]][s[k]] += 1
    out = []
    for t in texts:
        s, bits = symbols(t), 0.0
        for k in range(order, len(s)):
            barred = set()
            for d in range(order, -1, -1):
                seen = table.get(s[k - d : k])
                if not seen:
                    continue
                free = {x: c for x, c in seen.items() if x not in barred}
                whole = sum(free.values()) + len(free)
                if s[k] in free:
                    bits += math.log10(free[s[k]] / whole)
                    break
                if whole:
                    bits += math.log10(len(free) / whole)
                barred = set(seen)
            else:
                bits -= math.log10(ppm.SYMBOLS - len(barred))
        out.append(bits)
    return out


def test_quality_of_junk_heavy_sources(spark):
    plain = " ".join(f"w{k}" for k in range(50))
    junk = " ".join(f"w{k} #$%&" if k % 2 else f"v{k}" for k in range(50))
    rows = [(k, junk if k % 10 < 3 else plain, "fr", "heavy") for k in range(200)]  # of all rows, a seventh is junk
    rows += [(1000 + k, plain, "fr", "clean") for k in range(200)]
    # A source of code has symbols throughout; its own spread sets its limit.
    rows += [(2000 + k, plain.replace(" ", " $ ", 10 + k % 10), "en", "code") for k in range(100)]
    rows += [(3000 + k, plain, "en", "clean") for k in range(200)]
    got = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert {r.doc_id for r in got if not r.kept} == {k for k in range(200) if k % 10 < 3}
    assert {r.reasons for r in got if not r.kept} == {"symbols"}


def test_ppm(docs, texts, awkward, empty):
    got = {r.doc_id: r for r in ppm.ppm_scores(docs, block_bytes=100_000).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    low = {i: (t or "").encode().lower() for i, t in texts.items()}
    counts = Counter()
    for i, t in low.items():
        if not held[i]:
            counts.update([*t.split(), None])
    total, size = sum(counts.values()), len(counts)
    ids = sorted(texts)[:40]
    want = dict(zip(ids, brute_ppm([low[i] for i in texts if not held[i]], [low[i] for i in ids], ppm.ORDER), strict=True))
    for i in texts:
        tokens = [*low[i].split(), None]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (size + 1))) for w in tokens)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(tokens), sum(counts[w] > 0 for w in tokens), total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        if i in want:
            assert r.score == pytest.approx(want[i], rel=1e-9)
    rows = ppm.ppm_scores(awkward).collect()
    assert len(rows) == len(AWKWARD) and {r.n_tokens for r in rows if r.doc_id in (2, 3, 8)} == {1}
    assert ppm.ppm_scores(empty).count() == 0
    none = ppm.ppm_scores(awkward.filter("doc_id = 7"), held_out=F.lit(True)).first()
    assert none.score == pytest.approx(-2 * math.log10(257))


def brute_repeats(rows):
    first, out = {}, []
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            first[g] = min(first.get(g, math.inf), math.inf if i is None else i)
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < (math.inf if i is None else i) for j in range(13)}
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("chunk", [200, 1_500_000])
def test_substring_dedup(docs, texts, awkward, empty, chunk):
    got = substring_dedup.remove_repeats(docs, digests=True, bucket_bytes=20_000, chunk_words=chunk)
    assert Counter(tuple(r) for r in got.collect()) == brute_repeats(texts.items())
    rows = substring_dedup.remove_repeats(awkward, digests=True, chunk_words=chunk)
    assert Counter(tuple(r) for r in rows.collect()) == brute_repeats([(x[0], x[1]) for x in AWKWARD])
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_warc(spark, sf_dir):
    long = "é" * 80
    pages = [(1, "http://a/1", long), (2, "http://a/2", long), (2, "http://a/2", long), (3, None, None), (4, "u\r\nx", "short"), (5, "http://b", "short"),
             (None, "http://c", long), (6, "http://d", "body\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n tail")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    captures = warc.round_trip(frame)
    assert captures.select("request.record_id").filter("record_id is null").count() == 0
    got = Counter(tuple(r) for r in warc.page_digests(captures).collect())
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = Counter()
    for p, _, html in pages:
        size = len((html or "").encode())
        revisit = html == long and p != 1
        want[(p, size, digest(html), "revisit" if revisit else "response", 1 if revisit else None)] += 1
    assert got == want
    assert warc.page_digests(warc.round_trip(frame.limit(0))).count() == 0


def test_warc_members_and_orphans(spark, tmp_path):
    import gzip

    def record(kind, name, body, more=""):
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{name}>\r\n{more}Content-Length: {len(body.encode())}\r\n\r\n{body}\r\n\r\n".encode()

    inner = record("response", "fake", "z").decode()
    http = "Content-Type: application/http; msgtype=response\r\n"
    one = record("metadata", "x", "a: b", "WARC-Concurrent-To: <r>\r\n")
    two = record("response", "r", "HTTP/1.1 200 OK\r\n\r\n" + "body\r\n\r\n" + inner + inner + "\r\n tail", http)
    lost = record("revisit", "v", "HTTP/1.1 200 OK\r\n\r\n", http + "WARC-Refers-To: <elsewhere>\r\nWARC-Payload-Digest: sha256:abc\r\n")
    again = record("revisit", "w", "", "WARC-Refers-To: <r>\r\n")
    broken = b"WARC/1.0\r\nWARC-Type: response\r\nno length\r\n\r\nxx\r\n\r\n"
    cut = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <cut>\r\nContent-Length: 99\r\n\r\nshort"
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, (one, two, broken, lost, cut))))
    (tmp_path / "b.warc").write_bytes(again + b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <i>\r\nContent-Length: 0\r\n\r\n\r\n\r\n")
    records = warc.read_warc(spark, str(tmp_path))
    assert sorted(r.record_id for r in records.collect()) == ["<i>", "<r>", "<v>", "<w>", "<x>"]
    captures = warc.assemble(records)
    assert {r.capture_id: (r.metadata is not None, r.response.record_type) for r in captures.collect()} == {"<r>": (True, "response"), "<v>": (False, "revisit"), "<w>": (False, "revisit")}
    payload = "body\r\n\r\n" + inner + inner + "\r\n tail"
    digest = hashlib.sha256(payload.encode()).hexdigest()
    # No notes of our own writer are needed: bytes and digest of a revisit come from the record it names.
    got = Counter(tuple(r)[1:] for r in warc.page_digests(captures).collect())
    assert got == Counter([(len(payload), digest, "response", None), (len(payload), digest, "revisit", None), (None, "abc", "revisit", None)])


def test_warc_of_long_pages_and_clashing_columns(spark):
    long = "<p>" + "x\r\n" * 4_000_000  # 12 MB
    rows = [(1, "http://a/1", long, 7, "q"), (2, "http://a/2", long, 8, None), (3, "http://a/3", "WARC/1.0\r\n" * 50, 9, "")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, size int, digest string")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.page_digests(warc.round_trip(frame)).collect()}
    assert got == {1: (len(long), "response", None), 2: (len(long), "revisit", 1), 3: (500, "response", None)}


def test_line_dedup(docs, texts, awkward, empty):
    sites = defaultdict(set)
    source = {r.doc_id: r.source for r in docs.collect()}
    for i, t in texts.items():
        for x in (t or "").split("\n"):
            if WORD.search(x):
                sites[x.strip(" \t\n\r\x0b\f")].add(source[i])
    bad = {x for x, s in sites.items() if len(s) >= line_dedup.MIN_SITES}
    got = {r.doc_id: (r.n_removed, r.clean_text) for r in line_dedup.remove_boilerplate(docs).collect()}
    assert got == {r.doc_id: (r.n_removed, r.clean_text) for r in line_dedup.remove_boilerplate(docs, in_place=0).collect()}
    for i, t in texts.items():
        lines = (t or "").split("\n")
        kept = [x for x in lines if x.strip(" \t\n\r\x0b\f") not in bad]
        assert got[i] == (len(lines) - len(kept), "\n".join(kept))
    rows = line_dedup.remove_boilerplate(awkward, min_sites=2).collect()
    assert len(rows) == len(AWKWARD)
    assert [r.clean_text for r in rows if r.doc_id is None] == [""]
    assert line_dedup.remove_boilerplate(empty).count() == 0


def brute_mixing(cells, targets, rounds=mixing.ROUNDS):
    """(probability of each cell, goals and shares reached of each dimension), in plain Python."""
    total = sum(cells.values())
    goals, share = [], []
    for k, target in enumerate(targets.values()):
        held = defaultdict(float)
        for cell, t in cells.items():
            held[cell[k]] += t
        held = {v: t for v, t in held.items() if t}
        if isinstance(target, dict):
            rest = sum(t for v, t in held.items() if v not in target)
            left = max(0.0, 1 - sum(target.values()))
            listed = sum(t for v, t in held.items() if target.get(v))
            share_of_rest = (lambda v: left * held[v] / rest) if left > 1e-9 else (lambda v: sum(target[x] for x in held if x in target) * held[v] / listed)
            goal = {v: target[v] if v in target else share_of_rest(v) for v in held}
        else:
            goal = {v: t**target for v, t in held.items()}
        whole = sum(goal.values())
        goals.append({v: g / whole for v, g in goal.items() if g})
        share.append({v: t / sum(held.values()) for v, t in held.items()})
    listed = [s[v] / g for gs, s, t in zip(goals, share, targets.values()) if isinstance(t, dict) for v, g in gs.items()]
    part = max(mixing.LEAST_YIELD, min(1.0, mixing.MARGIN * min(listed)))
    for gs, s in zip(goals, share):
        for _ in range(mixing.CUTS):
            over = {v for v, g in gs.items() if g > s[v] / part}
            if not over:
                break
            full = {v for v, g in gs.items() if g >= s[v] / part}
            free = sum(g for v, g in gs.items() if v not in full)
            scale = (1 - sum(s[v] / part for v in full)) / free if free else 0
            gs.update({v: s[v] / part if v in full else g * scale for v, g in gs.items()})
    factor = [dict.fromkeys(gs, 1.0) for gs in goals]
    chance = lambda cell: min(1.0, part * math.prod(f.get(v, 0.0) for f, v in zip(factor, cell)))
    for _ in range(rounds):
        for k, gs in enumerate(goals):
            mass = defaultdict(float)
            for cell, t in cells.items():
                mass[cell[k]] += t * chance(cell)
            factor[k] = {v: factor[k][v] * g * part * total / mass[v] if mass[v] else 0.0 for v, g in gs.items()}
    out = {cell: chance(cell) for cell in cells}
    whole = sum(t * out[cell] for cell, t in cells.items())
    reached = [{v: sum(t * out[c] for c, t in cells.items() if c[k] == v) / whole for v in gs} for k, gs in enumerate(goals)]
    return out, goals, reached


def test_mixing_meets_all_marginals(spark):
    """With a scarce topic, a hot source and cells that are cut at one; against brute force."""
    import random

    rnd = random.Random(3)
    rows = []
    for k in range(6000):
        lang = ["en"] * 12 + ["fr", "de", "es"] * 2
        text = "1 2 3 4 5 6 7 8 9 10" if rnd.random() < 1 / 60 else "one two three four five six seven eight nine ten"
        rows.append((k, text + " x" * (k % 7), rnd.choice(lang), f"s{0 if rnd.random() < 0.4 else rnd.randrange(11)}"))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = mixing.mix(frame, mixing.TARGETS, mixing.production_dims()).collect()
    cells = defaultdict(int)
    for r in out:
        cells[r.source, r.lang, r.topic] += r.tokens
    want, goals, reached = brute_mixing(cells, mixing.TARGETS)
    for r in out:
        assert r.probability == pytest.approx(want[r.source, r.lang, r.topic], rel=1e-6)
    whole = sum(r.tokens * r.probability for r in out)
    for k, dim in enumerate(mixing.TARGETS):
        for v, goal in goals[k].items():
            got = sum(r.tokens * r.probability for r in out if r[dim] == v) / whole
            assert got == pytest.approx(goal, rel=0.01) and got == pytest.approx(reached[k][v], rel=1e-6)
    for v, share in mixing.TARGETS["lang"].items():  # no symbols here, so the two topics share the whole
        assert sum(r.tokens * r.probability for r in out if r.lang == v) / whole == pytest.approx(share, rel=0.01)
    assert any(r.probability == 1 for r in out)
    # The sample itself, and that the pipeline's form draws the same documents.
    ids = {r.doc_id for r in out if r.sampled}
    assert abs(sum(r.tokens for r in out if r.sampled) / whole - 1) < 0.1
    drawn = mixing.sample(frame, mixing.TARGETS, mixing.production_dims())
    assert drawn.columns == frame.columns and {r.doc_id for r in drawn.collect()} == ids


def test_mixing(docs, awkward, empty):
    cells = docs.select(*[c.alias(d) for d, c in mixing.production_dims().items()], mixing.n_words(F.col("text")).alias("tokens")).groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens"))
    raked, report = mixing.rake(cells, mixing.TARGETS)
    want, goals, reached = brute_mixing({(r.source, r.lang, r.topic): r.tokens for r in raked.collect()}, mixing.TARGETS)
    assert all(r.probability == pytest.approx(want[r.source, r.lang, r.topic], rel=1e-6, abs=1e-9) for r in raked.collect())
    for k, d in enumerate(mixing.TARGETS):
        assert {r[d]: (r.goal, r.reached) for r in report[d].collect()} == {v: pytest.approx((g, reached[k][v]), rel=1e-6) for v, g in goals[k].items()}
    rows = mixing.mix(awkward, mixing.TARGETS, mixing.production_dims(), rounds=2).collect()
    assert len(rows) == len(AWKWARD) and all(r.probability is not None for r in rows)
    assert mixing.mix(empty, mixing.TARGETS, mixing.production_dims(), rounds=1).count() == 0


def test_mixing_keeps_null_and_unlisted_values(spark, awkward):
    assert sum(mixing.TARGETS["lang"].values()) == 1
    langs = ["en"] * 12 + ["fr", "de", "es"] * 2 + ["it", None]  # the last two hold a tenth of the tokens
    rows = [(k, "one two three four five", lang, f"s{k % 2}") for k, lang in enumerate(langs * 100)]
    rows += [(-1, None, "pt", "s0"), (-2, "", None, "s0")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = {k: mixing.TARGETS[k] for k in ("source", "lang")}
    dims = {"source": F.col("source"), "lang": F.col("lang")}
    out = mixing.mix(frame, targets, dims, rounds=4).collect()
    assert len(out) == len(rows) and all(r.probability > 0 for r in out)
    cells = frame.select(mixing.n_words(F.col("text")).alias("tokens"), F.coalesce("lang", F.lit(mixing.NONE)).alias("lang")).groupBy("lang").agg(F.sum("tokens").alias("tokens"))
    goals = {r.lang: r.goal for r in mixing._marginal(cells, "lang", mixing.TARGETS["lang"]).collect()}
    assert goals == pytest.approx({"it": 0.05, mixing.NONE: 0.05} | {k: 0.9 * v for k, v in mixing.TARGETS["lang"].items()})
    # A share of 0 that is listed stays one, and rows of values without tokens are no reason to drop them.
    zero = mixing.mix(frame, {"lang": {"en": 1.0, "it": 0.0, "pt": 0.0}}, {"lang": F.col("lang")}, rounds=1).collect()
    assert {r.probability > 0 for r in zero if r.lang in ("it", "pt")} == {False}
    assert all(r.probability > 0 for r in zero if r.lang not in ("it", "pt"))
    assert all(r.probability > 0 for r in mixing.mix(awkward, mixing.TARGETS, mixing.production_dims(), rounds=2).collect())


def test_bpe(docs, texts, awkward, empty):
    tokenizers = pytest.importorskip("tokenizers")
    path = registry.vocabulary()
    library = tokenizers.Tokenizer.from_file(path)
    hard = ["ΑΣ İI 日本語 ١٢٣ a\x1cb\x85c\xa0d", "x" * 3000, "<|endoftext|>hi<|startoftext|>", "!!!???###" * 30, "é   　", "🙂👩‍👧"]
    model = bpe.BpeModel(path)
    for t in [*texts.values(), *hard]:
        want = library.encode(t or "", add_special_tokens=False)
        assert model.encode(t or "") == want.ids
        assert model.decode(want.ids) == library.decode(want.ids, skip_special_tokens=False)
    encoded = bpe.encode(awkward, path)
    rows = encoded.collect()
    assert len(rows) == len(AWKWARD) and all(len(r.ids) == r.n_tokens for r in rows)
    assert [(r.ids, r.decoded) for r in rows if r.doc_id == 2] == [([], "")]
    assert sorted(r.decoded for r in bpe.decode(encoded, path).collect()) == sorted(r.decoded for r in rows)
    assert bpe.encode(empty, path).count() == 0


def test_ngram_join(spark, docs, texts, awkward, empty):
    got = {tuple(r) for r in ngram_join.similarity_components(docs, bucket_bytes=50_000).collect()}
    assert got == jaccard_components(texts)
    rows = [tuple(r) for r in ngram_join.similarity_components(awkward).collect()]
    assert len(rows) == len(AWKWARD)
    by = {r[0]: r for r in rows}
    assert by[4][2] == 1 and by[None][2] == 1 and by[2] == (2, 0, 2) and by[7] == (7, 1, 7)
    assert ngram_join.similarity_components(empty).count() == 0


def test_ngram_join_of_near_copies(spark):
    """Chains, small sets on both sides of the boundary, and copies that are not alike each other."""
    import random

    rnd = random.Random(5)
    rows, k = [], 0
    for size in [5, 6, 7, 8, 9, 10, 12, 14, 17, 20, 30, 60, 200]:
        base = [f"w{rnd.randrange(10**6)}" for _ in range(size)]
        for _ in range(12):
            words = list(base)
            for _ in range(rnd.randrange(0, max(2, size // 25) + 1)):
                words[rnd.randrange(len(words))] = f"v{rnd.randrange(10**6)}"
            words = words[: len(words) - rnd.randrange(0, 3)] + [f"t{rnd.randrange(9)}"] * rnd.randrange(0, 2)
            rows.append((k, " ".join(words)))
            k += 1
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = jaccard_components(dict(rows))
    assert {tuple(r) for r in ngram_join.similarity_components(frame).collect()} == want
    # Lists dealt over many buckets give the same links.
    assert {tuple(r) for r in ngram_join.similarity_components(frame, bucket_bytes=2000, hot_list=2).collect()} == want
    assert {r.doc_id for r in ngram_join.drop_near_duplicates(frame).collect()} == {i for i, _, c in want if i == c}


def test_ngram_join_of_a_group_around_a_text(spark):
    """Copies with ever more changes: those far from the text they come from are near to nothing, or to some of the others only."""
    import random

    rnd = random.Random(7)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(160):
        words = list(base)
        for _ in range(rnd.randrange(0, 12)):
            words[rnd.randrange(len(words))] = f"v{rnd.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in ngram_join.similarity_components(frame).collect()} == jaccard_components(dict(rows))


def test_distinct_shingles_are_estimated():
    import numpy as np

    hashes = np.unique(np.random.default_rng(1).integers(0, 2**64, 300_000, dtype=np.uint64))
    assert ngram_join._distinct(hashes[: ngram_join.SMALLEST]) == pytest.approx(len(hashes), rel=0.1)
    assert ngram_join._distinct(hashes[:50]) == 50
    assert 1 <= ngram_join.boundary(2.0) < ngram_join.boundary(10.0**7) < 40


def test_boundary_is_chosen_by_cost():
    assert ngram_join.boundary(2.0) < ngram_join.boundary(100.0) <= 16
    assert all(ngram_join.least_overlap(a, a) * 175 >= 75 * 2 * a for a in range(1, 50))


def test_pipeline_stages(spark, docs, texts, sf_dir):
    now = docs
    ids = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, sf_dir)
        ids.append({r.doc_id for r in out.select("doc_id").collect()})
        if name != "encoding":
            assert out.columns == docs.columns
        now = out
    verdict = {r.doc_id: r.kept for r in quality.quality_rules(docs).collect()}
    assert ids[0] == {i for i, k in verdict.items() if k}
    least = {}
    for i in sorted(ids[0]):
        least.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[i]), i)
    assert ids[1] == set(least.values())
    assert ids[2] == {i for i, _, c in jaccard_components({i: texts[i] for i in ids[1]}) if i == c}
    # Mixing: the cells' probabilities, and the draw of each id.
    rows = {r.doc_id: r for r in docs.select("doc_id", mixing.n_words(F.col("text")).alias("tokens"), *[c.alias(d) for d, c in mixing.production_dims().items()]).collect()}
    cells = defaultdict(int)
    for i in ids[2]:
        cells[rows[i].source, rows[i].lang, rows[i].topic] += rows[i].tokens
    chance = brute_mixing(cells, mixing.TARGETS)[0]
    draw = lambda i: int(hashlib.sha256(f"{mixing.SEED}:{i}".encode()).hexdigest()[:13], 16) / 2**52
    assert ids[3] == {i for i in ids[2] if draw(i) < chance[rows[i].source, rows[i].lang, rows[i].topic]} and ids[3]
    # Encoding: the library's ids of each document that is left.
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(registry.vocabulary())
    for r in now.collect():
        want = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
    assert ids[4] == ids[3]


def test_pipeline_on_awkward_rows(spark, awkward, empty, sf_dir):
    for frame in (awkward, empty):
        now = frame
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, sf_dir)
            assert now.columns == frame.columns or name == "encoding"
            assert (now.count() > 0) == (frame is awkward)


def test_each_stage_decides_rows_not_ids(spark, sf_dir):
    """Repeated rows, and different texts under one id."""
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(1, a), (1, a), (1, a.replace(" ", "  ")), (2, a), (1, b), (3, b + " tail"), (None, a), (None, None), (None, None), (4, ""), (5, None), (6, "x")]
    frame = spark.createDataFrame([(i, t, "en", "s", n, "clash") for n, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_words int, key string")

    def kept(stage):
        out = stage(spark, frame, sf_dir)
        assert out.columns == frame.columns
        return Counter((r.doc_id, None if r.text is None else re.sub(" +", " ", r.text)) for r in out.collect())

    whole = [(i, t if t is None else re.sub(" +", " ", t)) for i, t in rows]
    assert kept(corpus_pipeline.exact_stage) == Counter([(1, a), (1, b), (3, b + " tail"), (4, ""), (6, "x")])
    near = kept(corpus_pipeline.near_stage)
    assert near == Counter([(1, a), (1, b), (None, None), (None, None), (4, ""), (5, None), (6, "x")])
    assert kept(corpus_pipeline.quality_stage) == Counter(x for x in whole if x[1] and len(x[1].split()) >= 10)
    assert len(corpus_pipeline.encode_stage(spark, frame, sf_dir).collect()) == len(rows)
