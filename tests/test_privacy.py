import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from inkwarden.functions import checksums, fakes
from inkwarden.functions.recognizers import REGISTRY
from inkwarden.operators import chunk, detect, replace
from inkwarden.plans import pipelines


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_offsets_are_code_points_of_the_original(spark):
    text = "é a@b.io 😀 c@d.org, a@b.io"
    found = {(r["start"], r["end"], r["value"]) for r in detect.detect(docs(spark, text), ["EMAIL_ADDRESS"]).collect()}
    assert found == {(m.start(), m.end(), m[0]) for m in re.finditer(r"[a-z]@[a-z]\.[a-z]+", text)}


def test_null_empty_and_blank_texts_have_no_spans(spark):
    assert detect.detect(docs(spark, None, "", "  \n")).count() == 0


def test_unknown_type_is_an_error(spark):
    with pytest.raises(ValueError):
        detect.detect(docs(spark, "x"), ["NO_SUCH"])


def test_overlaps_resolve_to_the_longer_first(spark):
    out = replace.anonymize(docs(spark, "see http://x.com/a@b.io now"), "mask", ["URL", "EMAIL_ADDRESS"]).first()
    assert out["anonymized_text"] == "see [URL] now"


def test_equal_values_get_equal_fakes_and_formats_stay(spark):
    rows = replace.anonymize(docs(spark, "pay 4111-1111-1111-1111", "pay 4111-1111-1111-1111 to DE89 3704 0044 0532 0130 00"), "entity_aware", ["CREDIT_CARD", "IBAN_CODE"]).orderBy("doc_id").collect()
    a, b = [r["spans"] for r in rows]
    assert a[0]["replacement"] == b[0]["replacement"] != "4111-1111-1111-1111"
    assert re.fullmatch(r"\d{4}-\d{4}-\d{4}-\d{4}", a[0]["replacement"])
    iban = b[1]["replacement"].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


@pytest.mark.parametrize("card", ["4222222222222", "378282246310005", "4111111111111111", "6304000000000000000"])
def test_fake_cards_pass_luhn_at_every_length(spark, card):
    fake = spark.range(1).select(fakes.card(fakes.Source(1, F.lit("CREDIT_CARD"), F.lit(card)), F.lit(card)).alias("f")).first()["f"]
    digits = [int(c) for c in reversed(fake)]
    assert len(fake) == len(card) and sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


@pytest.mark.parametrize(
    "rule, good, bad",
    [
        ("nhs", "943 476 5919", "943 476 5918"), ("abn", "51 824 753 556", "51 824 753 557"), ("tfn", "123 456 782", "123 456 783"), ("acn", "004 085 616", "004 085 617"),
        ("medicare", "2123 45670 1", "2123 45671 1"), ("pesel", "44051401359", "44051401358"), ("nif", "12345678Z", "12345678A"), ("nric", "S1234567D", "S1234567A"),
        ("aadhaar", "2341 2341 2346", "2341 2341 2347"), ("fiscal_code", "RSSMRA85T10A562S", "RSSMRA85T10A562T"), ("iban", "GB82 WEST 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 33"), ("dea", "AB1234563", "AB1234564"),
        ("ssn", "536-90-4399", "666-90-4399"),
    ],
)
def test_check_digits(spark, rule, good, bad):
    f = getattr(checksums, rule)
    row = spark.createDataFrame([(good, bad)], "g string, b string").select(f(F.col("g")), f(F.col("b"))).first()
    assert tuple(row) == (True, False)


def test_dates_shift_in_their_format(spark):
    d = spark.createDataFrame([("2020-02-28",), ("02/28/2020",), ("February 28, 2020",), ("junk",)], "v string")
    assert [r[0] for r in d.select(fakes.shift_date(F.col("v"), F.lit(2))).collect()] == ["2020-03-01", "03/01/2020", "March 1, 2020", None]


def test_chunks_are_lossless_and_respect_edges(spark):
    texts = ["One. Two! Three? " * 200, "x" * 500, "a", "", None, "no terminator at all " * 60]
    d = docs(spark, *texts)
    for strategy in ("sentence", "paragraph"):
        parts = chunk.chunks(d, strategy, 100, 20).select("doc_id", "chunk_index", chunk.core_text().alias("text"))
        assert {r["doc_id"]: r["text"] for r in chunk.reassemble(parts).collect()} == {i: t for i, t in enumerate(texts) if t}


def test_chunked_detection_equals_whole_detection(spark):
    text = ("word " * 37 + "me@example.com ") * 30
    d = docs(spark, text)
    columns = ["doc_id", "start", "end", "value"]
    assert sorted(map(tuple, chunk.detect_in_chunks(d, ["EMAIL_ADDRESS"], 300, 60).select(columns).collect())) == sorted(map(tuple, detect.detect(d, ["EMAIL_ADDRESS"]).select(columns).collect()))


def test_results_do_not_depend_on_partitions(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    runs = [sorted(map(tuple, replace.anonymize(d.repartition(n), "entity_aware").select("doc_id", "anonymized_text").collect())) for n in (1, 7)]
    assert runs[0] == runs[1]


def test_custom_type_with_a_bad_pattern_is_refused(spark):
    from inkwarden.operators import jobs

    types = spark.createDataFrame([], "name string, patterns array<string>")
    assert jobs.create_entity_type(spark, types, {"name": "A", "patterns": ["a+"]}).count() == 1
    with pytest.raises(ValueError):
        jobs.create_entity_type(spark, types, {"name": "B", "patterns": ["("]})


def test_chunk_edges_cut_no_value_whatever_their_place(spark):
    texts = [("word " * 37 + "me.and.you@mail.example.com 10.20.30.40, " + "é😀 " * 9) * 12, "x" * 700 + "@example.com " + "y" * 300, "1.2.3.4@example.com " * 60, "a" * 250 + " 1.2.3.4"]
    d = docs(spark, *texts)
    columns = ["doc_id", "entity_type", "start", "end", "value"]
    whole = sorted(map(tuple, detect.detect(d, ["EMAIL_ADDRESS", "IP_ADDRESS"]).select(columns).collect()))
    for size, overlap in [(200, 40), (231, 77), (120, 0)]:
        assert sorted(map(tuple, chunk.detect_in_chunks(d, ["EMAIL_ADDRESS", "IP_ADDRESS"], size, overlap).select(columns).collect())) == whole
    cards = docs(spark, *[" " * k + "tel (555) 123-4567 card 4111 1111 1111 1111  and " * 20 for k in range(3)])
    got = chunk.detect_in_chunks(cards, ["PHONE_NUMBER", "CREDIT_CARD"], 100, 30).select(columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, detect.detect(cards, ["PHONE_NUMBER", "CREDIT_CARD"]).select(columns).collect())) and len(got) == 120
    resolved = {r[0]: r[1] for r in replace.resolve_rows(chunk.detect_in_chunks(d, ["EMAIL_ADDRESS", "IP_ADDRESS"], 200, 40)).groupBy("doc_id").count().collect()}
    assert resolved == {r[0]: r[1] for r in replace.anonymize(d, "mask", ["EMAIL_ADDRESS", "IP_ADDRESS"]).selectExpr("doc_id", "size(spans)").collect() if r[1]}


def test_a_mask_uncovers_a_card(spark):
    d = docs(spark, "pay 4451718024887799 27.65.93.188 now", "nothing", None, "", "42 4366089147969128 1.2.3.4")
    out = {r["doc_id"]: (r["anonymized_text"], len(r["spans"])) for r in replace.mask_until_clean(d, ["CREDIT_CARD", "IP_ADDRESS"]).collect()}
    assert out[0] == ("pay [CREDIT_CARD] [IP_ADDRESS] now", 0) and out[1] == ("nothing", 0) and out[2] == (None, 0) and out[3] == ("", 0)
    assert len(out) == 5 and all(n == 0 for _, n in out.values())


def test_detection_matches_patterns_once(spark):
    plan = detect.detect(docs(spark, "1.2.3.4"), ["IP_ADDRESS"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_scores_of_missing_long_and_repeating_texts(spark):
    from inkwarden.operators import evaluate, score

    pairs = spark.createDataFrame([(1, "a b b c", "B c d"), (2, None, "a"), (3, "", ""), (4, "x", None)], "doc_id int, original string, synthesized string")
    assert {r["doc_id"]: (r["precision"], r["recall"]) for r in evaluate.lexical_score(pairs).collect()} == {1: (2 / 3, 3 / 4), 2: (0.0, 0.0), 3: (0.0, 0.0), 4: (0.0, 0.0)}
    rows = score.style_profile(docs(spark, "zebra apple apple mango mango berry lemon grape grape grape olive", "", None)).orderBy("doc_id").collect()
    assert rows[0]["domain_markers"] == ["grape", "apple", "mango", "berry", "lemon"] and rows[1]["domain_markers"] == []


def test_guards_and_looks_ahead_lose_no_match(spark):
    rng = random.Random(9)
    bits = ["Ada Lovelace", "Paul", "Swiss", "Paris", "New York", "Acme Corp", "Big Blue AG", "MegaCorp", "jo@x.org", "+1 (415) 555-0100", "415-555-0100", "4111 1111 1111 1111", "123-45-6789", "A12345678", "B1234567", "10.0.0.1", "http://a.b/c", "2024-01-31", "May 3, 2020", "GB82 WEST 1234 5698 7654 32", "0x" + "a1" * 20, "51 824 753 556", "943 476 5919", "S1234567D", "ABCPE1234F", "RSSMRA85T10A562S", "12345678Z", "x", "_", "é", " ", "-", ".", "(", "word", "7"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", " ", ", "]) for _ in range(rng.randrange(1, 9))) for _ in range(400)] + [None, "", "no such thing", "7"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = Counter((r["doc_id"], r["entity_type"], r["start"], r["end"]) for r in detect.detect(df, None, threshold=0.0).collect())
    want, checks = Counter(), 0
    seen = lambda t: re.sub(r"[^\x00-\x7f]", lambda m: "x" if m[0].isalpha() else " ", t)
    for i, t in enumerate(texts):
        for r in REGISTRY.values():
            for m in re.finditer(r.pattern, seen(t or ""), re.ASCII):
                checks += r.check is not None
                if r.check is None or got[(i, r.entity_type, m.start(), m.end())]:
                    want[(i, r.entity_type, m.start(), m.end())] += 1
    assert got == want and len({k[1] for k in want}) > 20 and checks > 100
    plan = detect.with_spans(df)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"RLIKE\([^,]*, \[0-9\]\)|\bRLIKE \[0-9\]", plan)) == 1


def test_job_does_not_search_unchanged_texts_again(spark):
    texts = ["mail ada@x.org now", "nothing here", "", None, "4111 1111 1111 1111 and 415-555-0100"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {r["doc_id"]: (r["anonymized_text"], r["found"], r["residual"], r["status"]) for r in pipelines.anonymize_job(df).collect()}
    assert rows[1][:3] == ("nothing here", 0, 0) and rows[2][:3] == ("", 0, 0) and rows[3][1:3] == (0, 0) and rows[0][1] == 1 and rows[4][1] >= 2
    some = {r["doc_id"]: (r["found"], r["residual"]) for r in pipelines.anonymize_job(df, types=["US_SSN"]).collect()}
    assert some[0] == (0, 1) and some[1] == (0, 0)  # other types are leftovers
    assert "__again" in pipelines.anonymize_job(df)._jdf.queryExecution().analyzed().toString()


def test_remainder_of_long_strings(spark):
    values = ["", "0", "7", "97", "Z", "DE00", "3214282912345698765432161182", "WEST12345698765432GB82", "9" * 80, "AZ09" * 30, None]
    got = [r["m"] for r in spark.createDataFrame([(v,) for v in values], "v string").select(checksums.mod97(F.col("v")).alias("m")).collect()]
    assert got == [None if v is None else int("".join(str(int(c, 36)) for c in v) or "0") % 97 for v in values]
    plan = spark.range(1).select(checksums.mod97(F.concat(F.lit("DE00"), F.col("id").cast("string"))).alias("m"))._jdf.queryExecution().analyzed().toString()
    assert "RLIKE" not in plan


def test_residual_scan_reports_what_one_round_of_masks_left(spark, tmp_path):
    from inkwarden.plans import catalog

    from .oracle import compare

    texts = ["pay 4451718024887799 27.65.93.188 now", "mail ada@x.org", "Ada Lovelace moved to Paris", None, "", "  ", "é 4366089147969128 1.2.3.4 RSSMRA85T10A562S 12345678Z S1234567D AB1234563"]
    valid = ["943 476 5919", "51 824 753 556", "123 456 782", "004 085 616", "2123 45670 1", "44051401359", "2341 2341 2346", "GB82 WEST 1234 5698 7654 32"]
    rows = list(enumerate([*texts, *valid, *[v[:-1] + str((int(v[-1]) + 1) % 10) for v in valid]])) + [(1, "id twice, Anna Meyer"), (None, "no id, 4111 1111 1111 1111")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    query = catalog.QUERIES["pii_residual"]
    out = sorted((tuple(r) for r in query(spark, str(tmp_path)).collect()), key=repr)
    assert len(out) == len(rows) and (0, 1, "failed") in out and (2, 2, "failed") in out and {(1, 0, "completed"), (1, 1, "failed"), (None, 0, "completed"), (3, 0, "completed"), (4, 0, "completed"), (5, 0, "completed")} <= set(out)
    assert {i for i, n, status in out if n > 0 and status == "failed"} >= set(range(6, 7 + len(valid)))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert compare(spark, con, query, catalog.ORACLES["pii_residual"], str(tmp_path)) == ""
