"""Operators 11 to 13 beside brute force, and all queries of the subpackage that have SQL."""

import hashlib
import random
import re
import zlib
from itertools import permutations

from inkwarden.llm import chat, filter_audit, period_runs, queries
from inkwarden.llm.bpe import default_path

TURNS = "conv_id bigint, turn bigint, role string, text string, head string, k int, edge string"
CLASHING = "doc_id bigint, text string, lang string, id string, mask int, part string, digest string, n int, words string, runs int"


# ---------------------------------------------------------------- 11
def turns(spark, rows):
    return spark.createDataFrame([(*r, "h", 1, "e") for r in rows], TURNS)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(rows):
    out, order = {}, lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        own = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=order)]
        loss = "".join(t for role, t in own if role == "assistant")
        out[conv] = (len(own), sha("".join(f"{a}\n{b}\n" for a, b in own)), len(loss), sha(loss))
    return out


PIECES = ["<turn ", "</turn>\n", "<\\turn", "<\\\\/turn>", "\\", "\n", "<", ">", " ", " ", "é", "😀", "日本", "ok", "'s", "<|endoftext|>", "### Assistant:", "\r", "\t", "1", "é", "turn user>"]


def test_chat_round_trip_of_hostile_texts(spark):
    rng = random.Random(11)
    text = lambda: rng.choice([None, "", "".join(rng.choice(PIECES) for _ in range(rng.randrange(12)))])
    role = lambda: rng.choice(["assistant", "user", "system", None, "", "a>\nb\\n</turn>", "assistant "])
    rows = [(rng.choice([*range(60), None]), rng.choice([None, 0, 1, 2, 3, 3]), role(), text()) for _ in range(500)]
    rows += rows[:20] + [(-7, k, r, "\\### Assistant: </turn> ok") for k, r in enumerate(["user", "assistant"])]
    got = {r[0]: (r[1], r[2], r[3], r[4]) for r in chat.chat_round_trip(turns(spark, rows)).collect()}
    assert got == expected(rows)


def test_chat_segments_of_one_conversation_give_the_ids_of_the_whole(spark):
    rng = random.Random(12)
    rows = [(5, k, rng.choice(["assistant", "user"]), "".join(rng.choice(PIECES) for _ in range(40))) for k in range(300)] + [(k, 0, "assistant", "x") for k in range(4)]
    made = chat.formatted(turns(spark, rows), chars=2000)
    own = sorted((r for r in made.collect() if r["conv_id"] == 5), key=lambda r: (r["task"], r["k"]))
    assert len(own) > 10 and all(r["edge"] for r in own)
    ids, ends = chat.Codec(default_path()).encode("".join(r["text"] for r in own))
    assert [i for r in own for i in r["ids"]] == ids.tolist()
    got = {r[0]: (r[1], r[2], r[3], r[4]) for r in chat.read_back(made).drop("formatted_chars", "n_tokens", "loss_tokens").collect()}
    assert got == expected(rows)


def test_chat_offsets_are_those_of_the_library_and_mask_by_brute_force():
    codec, rng = chat.Codec(default_path()), random.Random(13)
    for _ in range(200):
        text = "".join(rng.choice(PIECES) for _ in range(30))
        ids, ends = codec.encode(text)
        whole = codec.tokenizer.encode(text, add_special_tokens=False)
        assert whole.ids == ids.tolist() and b"".join(codec.bytes[i] for i in ids) == text.encode()
        for (a, b), end in zip(whole.offsets, ends):
            assert len(text[:a].encode()) < end <= len(text[:b].encode())
        cuts = sorted(rng.sample(range(len(text.encode()) + 1), 4))
        starts = [0, *ends[:-1]]
        for (s, e), (first, stop, lead, tail) in zip([cuts[:2], cuts[2:]], chat.masked([tuple(cuts[:2]), tuple(cuts[2:])], ends)):
            assert list(range(first, stop)) == [i for i in range(len(ids)) if starts[i] < e and ends[i] > s]
            said = b"".join(codec.bytes[i] for i in ids[first:stop])
            assert said[lead : len(said) - tail] == text.encode()[s:e]
    long = "ab \n\n c\n" * 3000 + "no break" * 50
    assert codec.encode(long, chars=1000)[0].tolist() == codec.encode(long)[0].tolist()


def test_chat_special_strings_are_plain_text_and_empty_tables(spark):
    made = chat.formatted(turns(spark, [(1, 0, "assistant", "<|endoftext|>" * 3)]))
    assert 50256 not in made.first()["ids"]
    assert chat.chat_round_trip(turns(spark, []).filter("false")).count() == 0


# ---------------------------------------------------------------- 12
def audited(rows, labels):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, _ in rows]
    key = lambda i: 2**63 - 1 if i is None else i
    fails = []
    for (i, t, _), w in zip(rows, words):
        t = t or ""
        f = {c for c, x in zip("ABCD", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), re.search(r"[#$%&*|]", t))) if x}
        fails.append(f | ({"E"} if any((u or "") == t and key(j) < key(i) for j, u, _ in rows) else set()))
    out = {}
    for part in {lang or "" for _, _, lang in rows}:
        own = [(f, labels.get(r[0], (0, 0))) for r, f in zip(rows, fails) if (r[2] or "") == part]
        for order in permutations("ABCDE"):
            left = own
            for k, c in enumerate(order):
                gone = [x for x in left if c in x[0]]
                left = [x for x in left if c not in x[0]]
                before = set(order[:k])
                out[part, "".join(order), k + 1] = [len(left), len(gone), sum(c in f and bool(f & before) for f, _ in own), sum(f == {c} for f, _ in own), sum(x[1][0] == 1 for x in gone), sum(x[1][1] == 1 for x in gone)]
        for c in "ABCDE":
            mine = [k for k in out if k[0] == part and k[1][k[2] - 1] == c and len(out[k]) == 6]
            total = sum(out[k][1] for k in mine)
            for k in mine:
                out[k].append(total)
    return out


def test_filter_audit_brute_force(spark):
    rng = random.Random(21)
    vocabulary = [f"w{i}" for i in range(300)] + ["ABC", "Q", "é", "#", "a|b", "x y"]
    texts = [None, "", " \t", "A", " ".join(f"w{i}" for i in range(100)), "\x0b".join(f"w{i % 80}" for i in range(100)), "x " * 20_000]
    texts += [" ".join(rng.choice(vocabulary[: rng.choice([60, 300, 306])]) for _ in range(rng.choice([40, 99, 100, 150]))) for _ in range(25)]
    rows = [(i, rng.choice(texts), rng.choice(["en", "fr", None, ""])) for i in range(150)] + [(None, texts[3], "en"), (None, texts[8], "fr"), (None, "once", "de"), (None, "once", "de")]
    rows += [(7, rows[7][1], "fr"), (7, rows[7][1], "fr"), (7, "other", "en")]
    labels = {i: (rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 150, 2)}
    df = spark.createDataFrame([(i, t, lang, "x", 1, "p", "d", 2, "w", 3) for i, t, lang in rows], CLASHING)
    known = spark.createDataFrame([(i, q, t, 1) for i, (q, t) in labels.items()] + [(4, None, None, 1), (None, 1, 1, 1)], "doc_id bigint, quality int, toxic int, id int")
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in filter_audit.interaction_audit(df, known).collect()}
    assert got == audited(rows, labels)
    assert filter_audit.interaction_audit(df.filter("false"), known).count() == 0
    assert filter_audit.interaction_audit(df, known.filter("false")).filter("good_lost > 0 OR toxic_lost > 0").count() == 0


def test_filter_audit_edges_are_80_a_part(spark):
    df = spark.createDataFrame([(1, "a", "en"), (2, "b", "fr")], "doc_id bigint, text string, lang string")
    rows, letters = filter_audit.marked(df, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    assert letters == "ABCDE" and filter_audit.lattice_edges(rows, 5).groupBy("part").count().collect()[0]["count"] == 80


# ---------------------------------------------------------------- 13
def brute_runs(words, least=24, times=3):
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_brute_force():
    rng = random.Random(31)
    for _ in range(600):
        n, letters = rng.randrange(160), rng.choice([1, 2, 3, 40])
        words = [b"%d" % rng.randrange(letters) for _ in range(n)]
        for _ in range(rng.randrange(4)):
            a, p = rng.randrange(n + 1), rng.randrange(1, 30)
            for i in range(a + p, min(n, a + p * rng.choice([3, 4, 9, 30]) + rng.randrange(p))):
                words[i] = words[i - p]
        for least, times in ((24, 3), (8, 2), (5, 4)):
            assert period_runs.runs_of(words, least, times) == brute_runs(words, least, times)
    assert period_runs.overlap(24, 3) == 16 and period_runs.runs_of([b"a"] * 50_000) == [(0, 50_000, 1)]


def test_words_outside_repeated_grams_are_never_searched():
    words = [b"w%d" % i for i in range(5000)]
    assert period_runs.survivors(words, 16) == []
    words[100:116] = words[3000:3016]
    assert period_runs.survivors(words, 16) == [(100, 116), (3000, 3016)]


def plant(i, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(i).encode())
    g = h // 10
    if i is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
    return words


def test_periodic_query_brute_force(spark, tmp_path):
    rng = random.Random(32)
    texts = [None, "", " \n", "a", "a " * 23, "a " * 24, "  b" * 40, "x y " * 30_000]
    texts += [" ".join(rng.choice("abcdefgh" * 3 + "xyz") + str(rng.randrange(rng.choice([2, 40]))) for _ in range(rng.randrange(400))) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "b " * 40), (None, None), (7, texts[7]), (7, "z")] + [(i, texts[i % 200]) for i in range(1000, 1600)]
    df = spark.createDataFrame([(i, t, "en", "x", 1, "p", "d", 2, "w", 3) for i, t in rows], CLASHING)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in queries.QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()), key=repr)
    want, some = [], 0
    for i, t in rows:
        words = plant(i, t)
        runs = brute_runs(words) if len(words) < 5000 else period_runs.runs_of(words)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        some += bool(runs)
        want.append((i, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone))))
    assert got == sorted(want, key=repr) and some > 40
    empty = period_runs.periodic_runs(df.filter("false"))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_words", "runs", "collapsed"]


def test_planted_words_are_those_of_the_rule(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 37))) for i in range(300)] + [(None, "a b"), (21, None)]
    got = sorted(((r["doc_id"], (r["text"] or "").split()) for r in queries.planted(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=repr)
    assert got == sorted([(i, plant(i, t)) for i, t in rows], key=repr)
