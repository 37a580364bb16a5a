"""Each operator beside brute force on small data, with nulls, empty texts, ties, repeated rows, empty tables and clashing columns."""

import bisect
import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwarden.llm import components, decontaminate, exact_dedup, line_dedup, line_repeats, near_dedup, packing, quality, token_counts, url_filter, warc
from inkwarden.llm.bpe import Encoder, default_path
from inkwarden.llm.common import whole
from inkwarden.llm.words import hashes_of

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, content string, v bigint, place int, score double"


def docs(spark, rows, start=0):
    """Documents with extra columns whose names operators use inside."""
    rows = [r if isinstance(r, tuple) else (i + start, r) for i, r in enumerate(rows)]
    return spark.createDataFrame([(i, t, None, "s", len(t or ""), "d", "c", 1, 2, 0.5) for i, t in rows], SCHEMA)


WORDS = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def odd(spark):
    return docs(spark, [None, "", " \t", "a", (None, "a"), (7, "a"), (7, "a"), "é 😀 日本", "x " * 30_000])


def test_scratch_folder_is_the_named_one(spark):
    from inkwarden.llm.common import scratch_dir

    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert scratch_dir(spark) == named if named else scratch_dir(spark).startswith("file:/")


# ---------------------------------------------------------------- 3
def test_exact_dedup_brute_force(spark):
    rng = random.Random(1)
    texts = [rng.choice(["a b", "ab", "a\tb ", "b", "", None, " ", "c\x0b", "c", "é\u00a0", "é"]) for _ in range(300)]
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs(spark, texts)).collect()}
    groups = defaultdict(list)
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for t in texts]
    for i, k in enumerate(norm):
        groups[k].append(i)
    for i, k in enumerate(norm):
        keep = min(groups[k], key=lambda j: (-len(texts[j] or ""), j))
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"], got[i]["text_sha256"]) == (keep, len(groups[k]), keep == i, hashlib.sha256(k.encode()).hexdigest())


def test_exact_dedup_odd_rows(spark):
    rows = exact_dedup.exact_dedup(odd(spark)).collect()
    assert len(rows) == 9 and sum(r["group_size"] == 3 and r["keep_id"] == 0 for r in rows) == 0
    assert {r["keep_id"] for r in rows if r["group_size"] == 4} == {3}
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


# ---------------------------------------------------------------- 4
def brute_components(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [len(s) for s in sets], [find(i) for i in range(len(sets))]


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = "edit%d" % rng.randrange(10**6)
        out.append(" ".join(w))
    return out


def test_near_dedup_brute_force(spark):
    rng = random.Random(2)
    texts = [prose(rng, rng.randint(1, 60)) for _ in range(40)]
    texts += family(rng, prose(rng, 120), 60, 9) + family(rng, prose(rng, 30), 30, 2) + ["a b c", "A b\tc", "a b", "", None, "  ", "x y z w"] * 2
    rng.shuffle(texts)
    n, comp = brute_components(texts)
    got = {r["doc_id"]: r for r in near_dedup.near_dedup(docs(spark, texts)).collect()}
    assert [got[i]["n_shingles"] for i in range(len(texts))] == n
    assert [got[i]["component_id"] for i in range(len(texts))] == comp
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())


def test_near_dedup_odd_rows(spark):
    rows = near_dedup.near_dedup(odd(spark)).collect()
    assert len(rows) == 9
    by = defaultdict(set)
    for r in rows:
        by[r["doc_id"]].add(r["component_id"])
    assert by[None] == {None} and by[0] == {0} and by[1] == {1} and by[7] == {3, 7}
    assert near_dedup.near_dedup(docs(spark, [])).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(5, 5)]
    got = {r["v"]: r["comp"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(1, 51)} | {i: 100 for i in range(101, 160)}


# ---------------------------------------------------------------- 5
def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_line_dedup_brute_force(spark):
    rng = random.Random(3)
    lines = ["".join(rng.choice("abé ") for _ in range(rng.randint(18, 30))).strip() or "x" for _ in range(60)]
    for s in list(lines):
        for _ in range(3):
            k = rng.randrange(len(s))
            lines.append(rng.choice([s[:k] + s[k + 1 :], s[:k] + "Q" + s[k:], s[:k] + "Z" + s[k + 1 :], s, s + " "]))
    rng.shuffle(lines)
    texts = ["\n".join(lines[i : i + 7]) for i in range(0, len(lines), 7)]
    places = [((i, k), s.strip(" \t\r\x0b\f")) for i, t in enumerate(texts) for k, s in enumerate(t.split("\n"))]
    places = [(p, s) for p, s in places if s]
    assert sum(len(s) < 20 for _, s in places) > 9
    want = {}
    for least in (20, 1):
        for p, s in places:
            near = [(q, s != t) for q, t in places if q < p and (s == t or min(len(s), len(t)) >= least and within_one(s, t))]
            if near:
                want[p] = min(near)
        got = {(r["doc_id"], r["line_no"]): ((r["keep_doc_id"], r["keep_line_no"]), bool(r["edits"])) for r in line_dedup.repeated_lines(docs(spark, texts), min_chars=least).collect()}
        assert len(want) > 60 and any(e for _, e in want.values())
        assert got == want


def test_short_lines_within_one_edit(spark):
    texts = ["a", "b", "ab", "abc\nxyz", "xy", "q\n\n q ", "é", "abcd", "abd", "ba", "ba1"]
    places = [((i, k), s.strip()) for i, t in enumerate(texts) for k, s in enumerate(t.split("\n")) if s.strip()]
    want = {p: min(q for q, t in places if q < p and within_one(s, t)) for p, s in places if any(q < p and within_one(s, t) for q, t in places)}
    assert {(r["doc_id"], r["line_no"]): (r["keep_doc_id"], r["keep_line_no"]) for r in line_dedup.repeated_lines(docs(spark, texts)).collect()} == want


def test_long_lines_within_one_edit(spark):
    rng = random.Random(33)
    long = "".join(rng.choice("abcdefgh ij") for _ in range(1_000_000)).strip()
    at = 765_432
    texts = [long, long[:at] + "#" + long[at + 1 :], long[:at] + long[at + 1 :], long[: at + 9] + "##" + long[at + 9 :], "x" + long[:5000], long[1:5000]]
    got = {(r["doc_id"], r["keep_doc_id"], r["edits"]) for r in line_dedup.repeated_lines(docs(spark, texts)).collect()}
    assert got == {(1, 0, 1), (2, 0, 1)}


def test_line_dedup_odd_rows_and_cutting(spark):
    line = "this line is long enough to count"
    d = docs(spark, [f"{line}\nkeep", None, "", f"own text\n{line}", line, (None, line)])
    removed = line_dedup.repeated_lines(d)
    assert {(r["doc_id"], r["line_no"], r["keep_doc_id"]) for r in removed.collect()} == {(3, 1, 0), (4, 0, 0), (None, 0, 0)}
    assert {r["doc_id"]: r["text"] for r in line_dedup.without_repeats(d).collect()} == {0: f"{line}\nkeep", 1: None, 2: "", 3: "own text"}
    assert line_dedup.repeated_lines(docs(spark, [])).count() == 0


# ---------------------------------------------------------------- 6
def test_repeated_spans(spark):
    rng = random.Random(4)
    passage = ". ".join(" ".join(rng.choice(WORDS) for _ in range(9)).capitalize() for _ in range(7)) + "."
    own = [f"Start {i} of it. " + prose(rng, 30).capitalize() + "." for i in range(6)]
    texts = [own[0] + "\n" + passage, own[1], own[2] + "\n" + passage.upper() + "\nThe end.", passage, None, "", own[5] + " Short one. Short one."]
    spans = {r["doc_id"]: r for r in line_repeats.repeated_spans(docs(spark, texts)).collect()}
    assert set(spans) == {2, 3} and spans[2]["keep_doc_id"] == 0
    assert texts[2][spans[2]["start"] : spans[2]["stop"]] == passage.upper()
    cut = {r["doc_id"]: r for r in line_repeats.remove_spans(docs(spark, texts), line_repeats.repeated_spans(docs(spark, texts))).collect()}
    assert cut[2]["text"] == own[2] + "\n\nThe end." and cut[1]["text"] == texts[1] and cut[4]["text"] is None
    assert line_repeats.repeated_spans(odd(spark)).filter("stop <= start or keep_doc_id > doc_id").count() == 0 and line_repeats.repeated_spans(docs(spark, [])).count() == 0


def brute_force_repeats(texts, width):
    """Words of each text in a window that occurs before without overlap, as sets of word numbers."""
    words = [re.findall(r"\w+", (t or "").lower()) for t in texts]
    first, out = {}, []
    for i, ws in enumerate(words):
        out.append(set())
        for k in range(len(ws) - width + 1):
            j, p = first.setdefault(tuple(ws[k : k + width]), (i, k))
            if j < i or p + width <= k:
                out[i].update(range(k, k + width))
    return out


def cut_texts(d):
    return sorted(((r["doc_id"], r["text"]) for r in line_repeats.remove_spans(d, line_repeats.repeated_spans(d)).collect()), key=repr)


@pytest.mark.parametrize("again", [7, None])
def test_repeats_are_cut_from_their_own_rows(spark, again):
    rng = random.Random(61)
    w, v = prose(rng, 60), prose(rng, 60)
    kept = cut_texts(docs(spark, [(1, w), (again, "intro " + w), (again, v), (again, None)]))
    assert kept == sorted([(1, w), (again, "intro "), (again, v), (again, None)], key=repr)


def test_short_paragraphs_and_scripts_without_blanks(spark):
    rng = random.Random(62)
    paragraph = prose(rng, 30)
    texts = [f"{prose(rng, 20)} start{k}.\n\n{paragraph}\n \n{prose(rng, 20)} end{k}." for k in range(6)]
    spans = line_repeats.repeated_spans(docs(spark, texts)).collect()
    assert sorted((r["doc_id"], texts[r["doc_id"]][r["start"] : r["stop"]], r["words"], r["keep_doc_id"]) for r in spans) == [(k, paragraph, 30, 0) for k in range(1, 6)]
    han = "，".join("".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(15)) for _ in range(30)) + "。"
    spans = line_repeats.repeated_spans(docs(spark, [han, "前言" + han, "不同的文字" * 3])).collect()
    assert [(r["doc_id"], r["start"], r["stop"]) for r in spans] == [(1, 2, 2 + len(han))]


def test_repeats_that_begin_and_end_inside_sentences(spark):
    rng = random.Random(14)
    texts = [None, "x " * 3000, "X, " * 50, "a b c " * 60]
    for n in range(38, 62):  # a passage of n words, cut out of the middle of sentences, without a sentence end or with some
        p = prose(rng, n).split()
        p = [w + "." if n % 3 == 0 and i % 8 == 7 else w for i, w in enumerate(p)]
        texts += [f"{prose(rng, 7)} {' '.join(p)} {prose(rng, 9)}. --- {prose(rng, 5)}", f"«{prose(rng, 3).upper()} {', '.join(p)}-{prose(rng, 30)}."]
    texts += [texts[4] + "\n***\n" + texts[10], " ".join(texts[20].split()[3:30] + texts[22].split()[5:28])]
    for width in (40, 7):
        want = brute_force_repeats(texts, width)
        got = [set() for _ in texts]
        for r in line_repeats.repeated_spans(docs(spark, texts), min_words=width).collect():
            at = [k for k, m in enumerate(re.finditer(r"\w+", texts[r["doc_id"]])) if r["start"] <= m.start() and m.end() <= r["stop"]]
            assert len(at) == r["words"] and r["keep_doc_id"] <= r["doc_id"]
            got[r["doc_id"]].update(at)
        assert got == want
    assert all(want[i] for i in range(9, 52, 2))


# ---------------------------------------------------------------- 7
def test_leaks_and_paraphrases(spark):
    rng = random.Random(5)
    items = [prose(random.Random(100 + i), 30) for i in range(8)] + [None, "", "w1"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    reworded = items[1].split()
    for k in (3, 8, 13, 18):
        reworded[k] = "other"
    fresh = lambda n: " ".join("z%d" % rng.randrange(5000) for _ in range(n))
    texts = [fresh(200) for _ in range(40)]
    texts += [fresh(55) + " " + items[0].upper() + ", " + fresh(90), fresh(10) + " " + " ".join(reworded) + " " + fresh(20), items[2], None, "", fresh(20_000) + " " + items[3]]
    texts += [fresh(30) + " " + items[4] + " " + fresh(30)] * 30  # a passage that a large share holds
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs(spark, texts), bench).collect()}
    assert found - {(i, 10) for i in range(len(texts))} == {(40, 0), (41, 1), (42, 2), (45, 3)} | {(46 + k, 4) for k in range(30)}
    assert decontaminate.leaks(docs(spark, []), bench).count() == 0 and decontaminate.leaks(docs(spark, texts[:2]), bench.limit(0)).count() == 0


# ---------------------------------------------------------------- 1
def test_quality_learns_from_its_folds_only(spark):
    rng = random.Random(6)
    good = lambda: ". ".join(prose(rng, 12).capitalize() for _ in range(8)) + "."
    junk = lambda: " ".join(rng.choice(["$$$", "###", "w1", "|", "%%%"]) for _ in range(100))
    texts = [good() if i % 4 else junk() for i in range(400)] + [None, ""]
    truth = [int(bool(i % 4)) for i in range(400)]
    labels = [(i, y) for i, y in enumerate(truth)] + [(9999, None), (None, 1)]
    d, lab = docs(spark, texts), spark.createDataFrame(labels, "doc_id bigint, quality int")
    rows = {r["doc_id"]: r for r in quality.quality_scores(d, lab).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    held = [i for i in range(400) if rows[i]["held_out"]]
    assert sum(rows[i]["predicted"] == truth[i] for i in held) >= 0.97 * len(held)
    flipped = spark.createDataFrame([(i, 1 - y if y is not None and i is not None and zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in labels], "doc_id bigint, quality int")
    again = {r["doc_id"]: r["score"] for r in quality.quality_scores(d, flipped).collect()}
    assert all(again[i] == rows[i]["score"] for i in rows) and all(0 <= s <= 1 for s in again.values())


def test_quality_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r["score"] for r in quality.quality_scores(odd(spark), none).collect()} == {1.0}
    assert quality.quality_scores(docs(spark, []), none).count() == 0
    assert quality.keep_good(odd(spark), none).columns == odd(spark).columns


# ---------------------------------------------------------------- 2
def test_warc_round_trip(spark, tmp_path):
    big = "<p>é</p>" * 30
    rows = [(3, "http://a/\r\nX: y", big), (1, None, big), (2, "u", "small"), (5, "u", "small"), (4, "u", None), (6, "u", ""), (6, "u", ""), (None, "u", big)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, digest string")
    out = warc.warc_round_trip(pages).collect()
    assert sorted((r["page_id"] or -1, r["record_type"], r["refers_to"]) for r in out) == sorted([(3, "revisit", 1), (1, "response", None), (2, "response", None), (5, "response", None), (4, "response", None), (6, "response", None), (6, "response", None), (-1, "revisit", 1)], key=lambda x: (x[0], x[1]))
    assert all(r["payload_digest"] == hashlib.sha256((h or "").encode()).hexdigest() and r["payload_bytes"] == len((h or "").encode()) for r in out for p, _, h in rows if p == r["page_id"])
    warc.write_archive(pages, str(tmp_path / "a"))
    record = [bytes(r["record"]) for r in warc.records(warc.read_archive(spark, str(tmp_path / "a"))).collect()]
    assert all(b.startswith(b"WARC/1.1\r\n") and b.endswith(b"\r\n\r\n") for b in record)
    assert sum(big.encode() in b for b in record) == 1
    for b in record:
        head, _, body = b.partition(b"\r\n\r\n")
        assert int(re.search(rb"Content-Length: (\d+)", head)[1]) == len(body) - 4
    assert warc.warc_round_trip(pages.limit(0)).count() == 0


# ---------------------------------------------------------------- 8
@pytest.mark.parametrize(
    "url, host, path, rule, verdict",
    [
        ("http://X.Net/en", "x.net", "/en", "net/", "block"), ("http://a.example.net/en/1?q=/x", "a.example.net", "/en/1", "example.net/en/", "allow"),
        ("https://example.com/de/#a", "example.com", "/de/", "example.com/de/", "block"), ("https://b.org/fr/x", "b.org", "/fr/x", "org/fr/", "allow"),
        ("http://notexample.com/de/", "notexample.com", "/de/", None, None), ("http://a.net", "a.net", "", None, None), ("http://a.net?x", "a.net", "", None, None), ("no scheme", "", "", None, None), (None, "", "", None, None),
        ("x://y://z/p", "y:", "//z/p", None, None), ("http://É.com\n/a", "É.com\n", "/a", None, None),
    ],
)
def test_url_parts_and_rules(spark, url, host, path, rule, verdict):
    d = spark.createDataFrame([(url,)], "url string").select(url_filter.host_of(F.col("url")).alias("h"), url_filter.path_of(F.col("url")).alias("p"))
    r, v = url_filter.rule_for(F.col("h"), F.col("p"))
    assert tuple(d.select("h", "p", r, v).first()) == (host, path, rule, verdict)


def test_url_models_tell_hosts_apart(spark):
    rng = random.Random(8)
    bad = ["casino-win", "cheap-pills", "adult-x", "spam-farm"]
    rows = [(i, f"http://{rng.choice(bad) if i % 10 == 0 else ''.join(rng.choice(['th', 'er', 'ou', 'tion', 'ble']) for _ in range(3))}.example.com/en/{rng.randrange(999)}") for i in range(1500)]
    pages = spark.createDataFrame([(*r, 1.0) for r in rows] + [(9000, None, 1.0), (None, "", 1.0)], "page_id bigint, url string, score double")
    got = {r["page_id"]: r["verdict"] for r in url_filter.url_verdicts(pages).collect()}
    assert [got[i] for i in range(1500)] == ["block" if i % 10 == 0 else "allow" for i in range(1500)] and got[9000] == got[None] == "allow"
    assert url_filter.url_verdicts(pages.limit(0)).count() == 0
    assert {r["verdict"] for r in url_filter.url_verdicts(pages.filter("page_id % 10 = 3")).collect()} == {"allow"}


# ---------------------------------------------------------------- 9
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_path())


TRICKY = [
    "", "a  b", "it's  'select 's ''s x's's <|endoftext|> a<|endoftext|>b", " \n\n x\t\ty  ", "é  x   y", "I'LL we'll 12 ab12 😀\u200d\x1c\x1c x\x85\x85y", "²½Ⅷ x²", "abcdefghij" * 300, "    " * 50, "日本語テキスト" * 50, "\xa0\xa0x",
    "a\n b", "x \n", "0" * 500,
]


def test_transducer_counts_as_the_library_does_in_any_chunks():
    lib, fst, rng = library(), token_counts.Transducer(default_path(), most_states=5000), random.Random(9)
    texts = TRICKY + ["".join(rng.choice("ab 's\n\t'lld.,0é<|endoftext|>日  ") for _ in range(rng.randint(0, 40))) for _ in range(500)]
    for t in texts:
        n = len(lib.encode(t, add_special_tokens=False).ids)
        assert fst.count(t) == n
        for size in (1, 3, 7):
            maps = [token_counts.map_of(t[i : i + size], fst) for i in range(0, len(t), size)]
            assert token_counts.scan(maps, fst).total(fst) == n


def test_token_counts_rows(spark):
    lib, rng = library(), random.Random(10)
    texts = TRICKY + [prose(rng, 3000), None]
    d = docs(spark, texts + [texts[0]])
    for chunk in (1 << 16, 97):
        got = {r["doc_id"]: r for r in token_counts.token_counts(d, chunk=chunk).collect()}
        for i, t in enumerate(texts):
            n = len(lib.encode(t or "", add_special_tokens=False).ids)
            assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 1024)
    assert token_counts.token_counts(docs(spark, [])).count() == 0 and token_counts.token_counts(odd(spark)).count() == 9


# ---------------------------------------------------------------- 10
def test_encoder_ids_are_the_librarys():
    lib, enc = library(), Encoder(default_path())
    assert all(enc.ids(t) == lib.encode(t, add_special_tokens=False).ids for t in TRICKY)


def best_fit(sizes, capacity=1024):
    """Sequences that best-fit decreasing needs."""
    gaps, n = [], 0
    for s in sorted(sizes, reverse=True):
        k = bisect.bisect_left(gaps, s)
        if k < len(gaps):
            gap = gaps.pop(k) - s
        else:
            n, gap = n + 1, capacity - s
        bisect.insort(gaps, gap)
    return n


def test_packing_is_whole_gapless_and_tight(spark):
    import numpy as np

    lib, rng = library(), random.Random(11)
    texts = [prose(rng, rng.choice([1, 5, 40, 200, 300, 900])) for _ in range(120)] + TRICKY + [None]
    rows = packing.best_fit_packing(docs(spark, texts)).collect()
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in enumerate(texts):
        ids, at = lib.encode(t or "", add_special_tokens=False).ids + [2], 0
        mine = sorted(pieces[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in mine] == list(range(len(mine))) and len(mine) == -(-len(ids) // 1024) and all(r["length"] == 1024 for r in mine[1:])
        for r in mine:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], dtype="<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for held in bins.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(bins) <= best_fit([r["length"] for r in rows]) + 2


def test_packing_rounds_and_odd_rows(spark):
    rng = random.Random(12)
    sizes = [(i, 0, 0, rng.randint(1, 1023), 0, i * 7919 % 65536) for i in range(3000)]
    packed = packing.pack(spark.createDataFrame(sizes, packing.PIECES), block_rows=300)
    fill = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert packed.count() == 3000 and all(r["n"] == r["end"] <= 1024 for r in fill) and len(fill) <= 1.02 * best_fit([s[3] for s in sizes])
    assert packing.best_fit_packing(odd(spark)).filter("length = 1").count() == 2
    assert packing.best_fit_packing(docs(spark, [])).count() == 0


# ---------------------------------------------------------------- the pipeline and the registered queries
def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    columns = d.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontaminate", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, sf)
        ids = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert out.columns == columns and ids <= {r["doc_id"] for r in d.select("doc_id").collect()} and ids
        d = out
    packed = corpus_pipeline.run(spark, sf)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == ids


CLASHES = "line_doc line_tag removed_lines near_doc near_tag near_row row_key leaky_key statistics __x __id __lines __gone __leaky tag first row".split()


def clashing(spark, rows):
    """Rows of (doc_id, text), and columns of the names that stages might use inside."""
    return spark.createDataFrame([(*r, *range(len(CLASHES))) for r in rows], "doc_id bigint, text string, " + ", ".join(f"{c} int" for c in CLASHES))


def left(df):
    assert df.columns == ["doc_id", "text", *CLASHES]
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("again", [5, None])
def test_stages_decide_rows_not_ids(spark, again):
    shared = "a shared line that repeats"
    rows = [(1, shared), (again, f"alpha\n{shared}"), (again, "beta\nprecious unique line"), (again, None), (again, "")]
    assert left(line_dedup.without_repeats(clashing(spark, rows), min_chars=20)) == sorted([(1, shared), (again, "alpha"), (again, "beta\nprecious unique line"), (again, None), (again, "")], key=repr)

    rng = random.Random(4)
    a, b, c = (prose(rng, 60) for _ in range(3))
    near = left(near_dedup.keep_one(clashing(spark, [(3, a), (again, a + " x"), (again, b), (again, c), (9, b + " y"), (again, None), (3, a)])))
    assert near == sorted([(3, a), (again, b), (again, c), (again, None)] + ([(again, a + " x"), (9, b + " y")] if again is None else []), key=repr)

    passage = " ".join(f"word{k}" for k in range(30))
    items = spark.createDataFrame([(1, passage)], "item_id bigint, text string")
    clean = [(again, prose(rng, 80)), (again, prose(rng, 80)), (again, None), (again, "")]
    assert left(decontaminate.keep_clean(clashing(spark, [*clean, (again, "so " + passage + " it was")]), items)) == sorted(clean, key=repr)


def test_near_links_of_rows_that_share_an_id(spark):
    rng = random.Random(5)
    a, b = prose(rng, 50), prose(rng, 50)
    got = [(r["doc_id"], r["component_id"]) for r in near_dedup.near_dedup(docs(spark, [(3, b), (7, b + " x"), (7, a), (9, a + " y")])).collect()]
    assert sorted(got) == [(3, 3), (7, 3), (7, 7), (9, 7)]


def test_quality_stage_with_clashing_names(spark):
    rows = [(i, f"good prose of some length, number {i}. It goes on." if i % 2 else "#$% ##") for i in range(80)] + [(None, None), (3, "")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id bigint, quality int")
    kept = left(quality.keep_good(clashing(spark, rows), labels))
    assert kept and set(kept) <= set(rows)


def test_dropping_lines_grows_with_the_lines(spark):
    import time

    text = "\n".join(f"line {k % 20_000} of many" for k in range(60_000))
    docs_ = docs(spark, [text])
    line_dedup.without_repeats(docs(spark, ["a\na"]), min_chars=10**9).collect()
    began = time.time()
    (row,) = line_dedup.without_repeats(docs_, min_chars=10**9).collect()
    assert row["text"] == "\n".join(f"line {k} of many" for k in range(20_000)) and time.time() - began < 40


def test_blocks_of_packing_stay_bounded_with_many_tasks(spark):
    pieces = packing.pieces_of(docs(spark, ["some words"] * 1000).repartition(200), "doc_id", "text", default_path(), 2, 1024)
    blocks = max(1, math.ceil(1000 / 16))
    counts = [r["count"] for r in pieces.withColumn("block", F.pmod(F.xxhash64("lot", F.lit(0)), F.lit(blocks))).groupBy("block").count().collect()]
    assert len(counts) > 55 and max(counts) < 48 and pieces.select("lot").distinct().count() > 990


def test_queries_match_sql(spark):
    from inkwarden.llm.queries import ORACLES, QUERIES

    from ..oracle import compare, connect

    con = connect("/root/testdata/sf0.001")
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES} == set(range(1, 14))
    for name, sql in ORACLES.items():
        assert compare(spark, con, QUERIES[name], sql, "/root/testdata/sf0.001") == "", name


def test_keep_one_tells_rows_with_one_id_apart(spark):
    d = docs(spark, [(7, "aa b"), (7, "zz"), (9, "zz "), (8, "q"), (8, "q"), (None, "n"), (None, "n ")])
    assert sorted((r["doc_id"] or -1, r["text"]) for r in exact_dedup.keep_one(d).collect()) == [(-1, "n "), (7, "aa b"), (8, "q"), (9, "zz ")]


def test_leaks_beside_brute_force(spark):
    """Windows with too little in common are passed over; all that a search without a latent space finds must be there."""
    rng = random.Random(15)
    common = ["the", "of", "and", "to", "in"]
    rich = lambda n: " ".join(rng.choice(common) if rng.random() < 0.4 else "z%d" % rng.randrange(3000) for _ in range(n))
    items = [rich(n) for n in (3, 9, 16, 24, 30, 37, 48, 100)]
    texts = [rich(rng.randint(1, 300)) for _ in range(60)]
    for item in items:
        for drop in (0, 0.15, 0.3, 0.6):
            w = [x if rng.random() >= drop else "y%d" % rng.randrange(10**6) for x in item.split()]
            texts.append(f"{rich(rng.randint(0, 90))} {' '.join(w)} {rich(rng.randint(0, 90))}")
    texts = texts + [texts[-1], None, ""]
    want = set()
    for j, item in enumerate(items):
        w = item.split()
        n = -(-len(w) // 48)
        for k in range(n):
            part = w[len(w) * k // n : len(w) * (k + 1) // n]
            for i, t in enumerate(texts):
                ws = (t or "").split()
                for at in range(max(1, len(ws) - len(part) + 1)):  # regions of the part's length: what any window around them holds too
                    if decontaminate.common_subsequence(part, ws[at : at + len(part)]) >= 0.7 * len(part):
                        want.add((i, j))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")).collect()}
    assert len(want & got) >= 0.97 * len(want) and len(want) > 20
    assert all(i >= 60 or (i, j) in want for i, j in got if j > 1)  # nothing in clean documents


def test_latent_space_is_fitted_on_all_passages(spark):
    rng = random.Random(17)
    prose_of = lambda n: " ".join("w%d" % rng.randrange(60) if rng.random() < 0.7 else "z%d" % rng.randrange(9) for _ in range(n))
    q = decontaminate.queries_of([(1, " ".join("w%d" % k for k in range(45)))], 5)
    texts = [prose_of(n) for n in (1, 47, 48, 49, 96, 500, 3000)] + ["", "z1 z2"]
    frame = docs(spark, texts + [None]).select("doc_id", whole(F.col("text")).alias("text"))
    slots = decontaminate.slots_of(frame, q)
    idf, passages = decontaminate.inverse_frequencies(slots, len(q.vocabulary))
    want, n = np.zeros((len(q.vocabulary),) * 2), 0
    for text in texts:
        s = q.vocabulary(hashes_of(text))
        for k in range(0, len(s), decontaminate.MOST_WORDS):
            x = np.bincount(s[k : k + decontaminate.MOST_WORDS], minlength=len(idf)) * idf
            x[:-1] /= np.sqrt((x[:-1] ** 2).sum() + x[-1] * idf[-1])  # other words count in the length only, each as one
            want, n = want + np.outer(x[:-1], x[:-1]), n + 1
    for most in (1 << 23, 100, 1):
        got = np.zeros_like(want)
        for r in decontaminate.gram_rows(slots, idf, most).collect():
            got[r.slot, r.slot :] += r.cells
        assert np.allclose(got, np.triu(want), atol=1e-4) and passages == n == 82
    space = decontaminate.fit_space(q, slots, idf, passages, 8)
    own = decontaminate.Rows(q.parts[0], np.array([len(q.parts[0])]), idf)
    g = want / n + own.gram(np.eye(len(idf), dtype=np.float32))[:-1, :-1]
    v = (space.vectors / idf[:, None])[:-1]
    assert np.trace(v.T @ g @ v) > 0.95 * np.sort(np.linalg.eigvalsh(g))[-8:].sum()


def test_url_models_block_hosts_without_their_seed_word(spark):
    rng = random.Random(16)
    rows = [f"http://{rng.choice(['casino', 'poker', 'bets'])}-{rng.choice(['royal', 'jackpot', 'slots'])}.com/spin/{rng.randrange(99)}" if i % 5 == 0 else f"http://{rng.choice(['news', 'museum', 'garden'])}-{rng.choice(['daily', 'house', 'plants'])}.com/read/{rng.randrange(99)}" for i in range(1000)]
    unseen = ["http://jackpotslots.com/spin/1", "http://royalslots.com/spin/3", "http://gardenhouse.com/read/2", "http://dailymuseum.com/read/5"]
    pages = spark.createDataFrame(list(enumerate(unseen + rows)), "page_id bigint, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.url_verdicts(pages).collect()}
    assert [got[i] for i in range(4)] == ["block", "block", "allow", "allow"]


def test_url_scores_equal_brute_force_counts(spark):
    rng = random.Random(17)
    urls = [f"http://{rng.choice(['casino', 'poker'])}-{rng.choice('abcé')}.com/{'spin' * rng.randrange(3)}" if i % 4 == 0 else f"http://{rng.choice(['news', 'art'])}{i}.com/r{i % 7}" for i in range(240)]
    urls += [urls[0], urls[1], None, "", "http://x.com/" + "ab" * 5000]
    pages = spark.createDataFrame([(i, u, "t", True) for i, u in enumerate(urls)], "page_id bigint, url string, text string, held boolean")
    got = {r["page_id"]: r for r in url_filter.url_verdicts(pages).collect()}
    text = {i: r["host"] + r["path"] for i, r in got.items()}
    held = {t: zlib.crc32(t.encode()) % 4 == 0 for t in text.values()}
    seeded = {i: bool(set(re.split("[^a-z0-9]+", r["host"])) & set(url_filter.SEEDS)) for i, r in got.items()}
    pairs, contexts = ({c: {} for c in (False, True)} for _ in range(2))
    cuts = lambda t, at: [("\x02" * 4 + t)[at + 4 - k : at + 5] for k in range(5)]
    for i, t in text.items():
        for at in range(len(t) if held[t] else 0, len(t)):
            for g in cuts(t, at):
                pairs[seeded[i]][g] = pairs[seeded[i]].get(g, 0) + 1
                contexts[seeded[i]][len(g), g[:-1]] = contexts[seeded[i]].get((len(g), g[:-1]), 0) + 1
    for i, t in text.items():
        total = 0.0
        for at in range(len(t)):
            p = {}
            for c in (False, True):
                p[c] = 1 / 256
                for g in cuts(t, at):
                    p[c] = (pairs[c].get(g, 0) + 30 * p[c]) / (contexts[c].get((len(g), g[:-1]), 0) + 30)
            total += math.log(p[False] / p[True])
        assert got[i]["score"] == pytest.approx(total / max(1, len(t)), abs=1e-8)
    assert {r["verdict"] for i, r in got.items() if seeded[i]} == {"block"} and got[242]["verdict"] == got[243]["verdict"] == "allow"
