import datetime as dt
import ipaddress
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import scalar
from veilwright import Keyring, TableTransform, compile_rule, table_info, transform
from veilwright.functions.digest import consistent_payload, digest_mod, digest_words, keyed_digest, row_payload
from veilwright.functions.text import float_text, nfc_trim
from veilwright.plans.rules import STRATEGIES
from veilwright.plans.schema import ColumnInfo

# The run key of a fixed test vector: 32 bytes of `A` as seed, an all-zero policy hash.
VECTOR_KEY = bytes.fromhex("85e438857d317aae863cd6114eee815efc730f80baad389c8d5e7e7f0fcd45fb")
REFERENCE = dt.date(2026, 1, 2)


@pytest.fixture(scope="module")
def vector():
    return Keyring(VECTOR_KEY, REFERENCE)


@pytest.fixture(scope="module")
def keyring():
    return Keyring.derive(b"A" * 32, "sha256:" + "0" * 64, REFERENCE)


def run(spark, keyring, column, values, key_type="long", data_type=None, **kwargs):
    data_type = data_type or T.StringType()
    schema = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("value", data_type)])
    df = spark.createDataFrame(list(enumerate(values)), schema)
    plan = TableTransform(
        "demo", "people", (compile_rule({"name": "value", **column}),), (ColumnInfo("value", data_type),),
        (ColumnInfo("id", T.LongType(), False),), kwargs.get("where"),
    )
    return [r["value"] for r in transform(df, plan, keyring).orderBy("id").collect()]


PARAMS = {"alphanumeric": {"length": 16}, "digits": {"length": 16}, "constant": {"value": "SANDBOX"}}


def rule(name, **params):
    merged = {**PARAMS.get(name, {}), **params}
    return {"strategy": name, **({"params": merged} if merged else {})}


def test_golden_vector_and_normalization(spark, vector):
    got = run(spark, vector, rule("hash"), ["  Café  ", "Café", "　Café "])
    assert set(got) == {"b63d04a81e4d68f734d5edad2a8b4a0a43df07a8df99b17d0df310104ff12b04"}


@pytest.mark.parametrize("column,want", [
    (rule("phone"), "264739072731109"),
    (rule("vatId"), "DE760870822"),
    (rule("iban"), "DE33355741174790616631"),
    (rule("hash", length=12), "6af7bd204c90"),
    (rule("hash", encoding="base64"), "ave9IEyQIIReG+ycZkF/ArZCGaw9NLUQq0zaHuXvT+U="),
])
def test_exact_vectors(spark, vector, column, want):
    assert run(spark, vector, column, ["original-value"]) == [want]


def test_email_suffix_vector(spark, vector):
    got = run(spark, vector, rule("email", domain="example.invalid"), [" PERSON@EXAMPLE.COM ", "person@example.com"])
    assert got[0] == got[1] and got[0].endswith("-919915e9f946@example.invalid")


def test_row_vectors(spark, vector):
    h = spark.range(1).select(
        keyed_digest(vector, row_payload("demo", "people", F.lit('[\\"tenant\\",42]'), "value")).alias("h")
    )
    row = h.select("h", digest_mod(F.col("h"), 10**16).alias("digits"),
                   digest_mod(F.col("h"), 101).alias("number")).first()
    assert str(row["digits"]).zfill(16) == "5423193786602368" and row["number"] == 45


@pytest.mark.parametrize("modulus", [
    1, 2, 7, 101, 10**9, 10**15, 10**18, 2**31, 2**62, 3 * 2**40, 2**62 - 1, 2**63, 2**64 - 1, 2**64, 10**19,
    10**25, 10**33, 5**25, 999999999989, 3 * 2**59, 2**61, 7**21,
])
def test_digest_mod_matches_big_integers(spark, keyring, modulus):
    df = spark.range(300).select(keyed_digest(keyring, F.col("id").cast("string").cast("binary")).alias("h"))
    rows = df.select("h", digest_mod(F.col("h"), modulus).cast("decimal(38,0)").alias("r")).collect()
    assert all(int(row["r"]) == int(row["h"], 16) % modulus for row in rows)


@pytest.mark.parametrize("length", [1, 9, 18, 19, 33, 34, 77, 78, 79, 200, 4096])
def test_digits_of_every_width(spark, keyring, length):
    got = run(spark, keyring, rule("digits", length=length), ["a", "b", "c"])
    for i, value in enumerate(got):
        h = scalar.digest(keyring, "digits", row=("demo", "people", f"[{i}]", "value"))
        assert value == scalar.digits(h, length)


@pytest.mark.parametrize("low,high", [(0, 100), (-50, 50), (-2**63, 2**63 - 1), (0, 2**63 - 1), (5, 5), (-10, 10**15)])
def test_number_ranges(spark, keyring, low, high):
    got = run(spark, keyring, rule("number", min=low, max=high), [1, 2, 3, 4], data_type=T.LongType())
    for i, value in enumerate(got):
        h = scalar.digest(keyring, "number", row=("demo", "people", f"[{i}]", "value"))
        assert value == scalar.number(h, low, high)


@pytest.mark.parametrize("name", STRATEGIES)
def test_every_strategy_is_deterministic_under_partitioning(spark, keyring, name):
    schema = "id long, value string"
    df = spark.createDataFrame([(i, f"value-{i % 50}") for i in range(200)], schema)
    plan = TableTransform(
        "demo", "people", (compile_rule({"name": "value", **rule(name)}),), (ColumnInfo("value", T.StringType()),),
        (ColumnInfo("id", T.LongType(), False),),
    )
    one = {r["id"]: r["value"] for r in transform(df.repartition(1), plan, keyring).collect()}
    many = {r["id"]: r["value"] for r in transform(df.repartition(17), plan, keyring).collect()}
    assert one == many
    if name == "null":
        assert set(one.values()) == {None}
    else:
        assert all(one.values())
    if plan.rules[0].consistent:
        assert all(one[i] == one[i + 50] for i in range(150))


def test_formats(spark, keyring):
    values = [f"input {i}" for i in range(300)]
    for value in run(spark, keyring, rule("uuid"), values):
        assert re.fullmatch(r"[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}", value)
    for value in run(spark, keyring, rule("ipv4Public"), values):
        address = ipaddress.ip_address(value)
        assert address.is_global and not address.is_multicast and not address.is_reserved
    for value in run(spark, keyring, rule("date"), values):
        assert dt.date(1950, 1, 1) <= dt.date.fromisoformat(value) <= REFERENCE
    for value in run(spark, keyring, {"strategy": "date", "params": {"from": "2020-02-28", "to": "2020-03-01",
                                                                      "format": "datetime"}}, values):
        moment = dt.datetime.strptime(value, "%Y-%m-%d %H:%M:%S")
        assert dt.datetime(2020, 2, 28) <= moment <= dt.datetime(2020, 3, 1) and len(value) == 19
    for value in run(spark, keyring, rule("iban"), values):
        assert int(value[4:] + "1314" + value[2:4]) % 97 == 1
    for value in run(spark, keyring, rule("email"), values):
        local, domain = value.split("@")
        assert re.fullmatch(r"[a-z.]+-[0-9a-f]{12}", local) and re.fullmatch(r"[a-z]+\.[a-z]+", domain)
    for length, case in ((1, "Mixed"), (16, "Upper"), (17, "Lower"), (32, "Mixed"), (33, "Upper"), (4096, "Mixed")):
        for value in run(spark, keyring, rule("alphanumeric", length=length, case=case), values[:3]):
            assert len(value) == length and set(value) <= set(scalar.ALPHA[case])
    for sentences in (1, 3, 100):
        for value in run(spark, keyring, rule("text", sentences=sentences, maxLength=4096), values[:5]):
            assert len(value) == 4096 or value.count(".") == sentences
    assert all(len(v) <= 9 for v in run(spark, keyring, rule("text", maxLength=9), values))


def test_public_ipv4_ranks_cover_exactly_the_public_space():
    from veilwright.operators.strategies import _reserved_ranges, public_ipv4_steps

    count, steps = public_ipv4_steps()

    def address(rank):
        shift = 0
        for threshold, skipped in steps:
            if rank >= threshold:
                shift = skipped
        return rank + shift

    ranges = _reserved_ranges()
    probes = {0, count - 1} | {t + d for t, _ in steps for d in (-1, 0, 1) if 0 <= t + d < count}
    for rank in probes:
        value = address(rank)
        assert 0 <= value < 2**32 and not any(b <= value < b + s for b, s in ranges)
    assert len({address(rank) for rank in probes}) == len(probes)


@pytest.mark.parametrize("text", ["éabc界", "ab", "a", "abc", "x" * 300])
def test_mask(spark, keyring, text):
    for prefix, suffix in ((1, 1), (0, 0), (0, 2), (3, 0), (2, 2), (4096, 4096)):
        got = run(spark, keyring, rule("mask", keepPrefix=prefix, keepSuffix=suffix, maskChar="●"), [text])
        assert got == [scalar.mask(text, prefix, suffix, "●")]


def test_null_and_empty_handling(spark, keyring):
    for name in ("constant", "hash", "null", "digits", "mask"):
        assert run(spark, keyring, rule(name), [None, ""]) == [None, ""]
    both = {"onNull": "Generate", "onEmpty": "Generate"}
    assert run(spark, keyring, {**rule("constant"), **both}, [None, ""]) == ["SANDBOX", "SANDBOX"]
    empty = scalar.digest(keyring, "hash", "").hex()
    assert run(spark, keyring, {**rule("hash"), **both}, [None, "", "   "]) == [empty] * 3
    # Blank text is not empty: it is replaced even though it trims to nothing.
    assert run(spark, keyring, rule("hash"), ["   "]) == [empty]
    assert run(spark, keyring, {**rule("null"), **both}, ["", "x"]) == [None, None]


def test_ignore_where_protects_matching_and_unknown_rows(spark, keyring):
    got = run(spark, keyring, rule("constant"), ["keep", "go", "go"], where="CASE id WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END")
    assert got == ["keep", "go", "SANDBOX"]


def test_consistent_digits_of_different_widths_share_a_suffix(spark, keyring):
    long = run(spark, keyring, {**rule("digits", length=12), "consistent": True}, ["a", "b"])
    short = run(spark, keyring, {**rule("digits", length=5), "consistent": True}, ["a", "b"])
    assert all(a.endswith(b) for a, b in zip(long, short))


def test_other_input_types(spark, keyring):
    moment = dt.datetime(2024, 5, 6, 7, 8, 9, 120000)
    schema = T.StructType([
        T.StructField("id", T.LongType(), False),
        T.StructField("d", T.DateType()), T.StructField("t", T.TimestampNTZType()), T.StructField("b", T.BinaryType()),
        T.StructField("m", T.DecimalType(8, 2)), T.StructField("f", T.DoubleType()),
    ])
    df = spark.createDataFrame([(1, moment.date(), moment, "Käse".encode(), Decimal(12), 1.5)], schema)
    fixed = {"strategy": "date", "params": {"from": "2000-01-01", "to": "2000-01-01"}}
    numeric = {"strategy": "number", "params": {"min": 7, "max": 7}}
    rules = {"d": fixed, "t": fixed, "b": rule("hash", length=10), "m": numeric, "f": numeric}
    plan = TableTransform(
        "demo", "people", tuple(compile_rule({"name": n, **c}) for n, c in rules.items()),
        tuple(ColumnInfo(n, schema[n].dataType) for n in rules), (ColumnInfo("id", T.LongType(), False),),
    )
    out = transform(df, plan, keyring)
    assert out.schema == schema
    row = out.first()
    assert row["d"] == dt.date(2000, 1, 1) and row["t"] == dt.datetime(2000, 1, 1)
    assert bytes(row["b"]) == scalar.digest(keyring, "hash", "Käse").hex()[:10].encode()
    assert row["m"] == 7 and row["f"] == 7.0


@pytest.mark.parametrize("value,want", [
    (1.5, "1.5"), (100.0, "100"), (0.0, "0"), (-2.25, "-2.25"), (1e7, "10000000"), (1.2345e10, "12345000000"),
    (1e20, "100000000000000000000"), (1e21, "1e+21"), (1.5e300, "1.5e+300"), (0.001, "0.001"),
    (0.00012, "0.00012"), (0.00001, "1e-05"), (-1.25e-7, "-1.25e-07"), (123456789.125, "123456789.125"),
])
def test_float_text(spark, value, want):
    df = spark.createDataFrame([(value,)], "v double")
    assert df.select(float_text(F.col("v"))).first()[0] == want


def test_nfc_trim_matches_python(spark):
    import unicodedata

    from veilwright.functions.text import WHITE_SPACE

    values = ["", " a ", " x ", "é", "가", "ﬁ", "Å", "​z​", "ạ̇"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(nfc_trim(F.col("v"))).collect()]
    assert got == [unicodedata.normalize("NFC", v.strip(WHITE_SPACE)) for v in values]


def test_settled_texts_need_no_normalisation(spark):
    import sys
    import unicodedata

    from veilwright.functions.text import _UNSETTLED

    # Every character that composition may touch is among those sent to Python.
    moved = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and (
        unicodedata.normalize("NFC", chr(c)) != chr(c) or unicodedata.combining(chr(c)))]
    moved += [chr(c) for c in range(0x1161, 0x1176)] + [chr(c) for c in range(0x11A8, 0x11C3)]
    df = spark.createDataFrame([(c,) for c in moved], "c string")
    assert [hex(ord(r[0])) for r in df.where(~F.col("c").rlike(_UNSETTLED)).collect()] == []


def test_bytes_that_are_no_text_are_hashed_as_they_are(spark):
    values = [b"\xff\xfe", b" \xff\n", b"\xa0x", "\u00a0e\u0301 ".encode(), b"", None, "e\u0301".encode() + b"\xff"]
    df = spark.createDataFrame([(bytearray(v) if v is not None else None,) for v in values], "v binary")
    got = [r[0] for r in df.select(nfc_trim(F.col("v").cast("string")).cast("binary")).collect()]
    want = [b"\xff\xfe", b"\xff", b"\xa0x", "\u00e9".encode(), b"", None, "e\u0301".encode() + b"\xff"]
    assert [None if g is None else bytes(g) for g in got] == want


def test_filters_pass_below_a_consistent_rule(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(50).selectExpr("id", "string(id) v").write.parquet(path)
    df = spark.read.parquet(path)
    info = table_info(df.schema)
    plan = TableTransform("demo", "t", (compile_rule({"name": "v", "strategy": "hash"}),), (info.column("v"),), (info.column("id"),))
    keyring = Keyring.derive(b"A" * 32, "sha256:" + "0" * 64, REFERENCE)
    shown = transform(df, plan, keyring).where("id = 3")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,3)" in shown
    wide = [({"strategy": "digits", "params": {"length": 33}, "consistent": False}), {"strategy": "number", "params": {"max": 2**62 + 2}}]
    for rule in wide:
        plan = TableTransform("demo", "t", (compile_rule({"name": "v", **rule}),), (info.column("v"),), (info.column("id"),))
        assert "Python" not in transform(df, plan, keyring)._jdf.queryExecution().executedPlan().toString()


def test_keys_differ_by_seed_policy_and_namespace():
    base = Keyring.derive(b"A" * 32, "sha256:" + "0" * 64, REFERENCE)
    others = [
        Keyring.derive(b"B" * 32, "sha256:" + "0" * 64, REFERENCE),
        Keyring.derive(b"A" * 32, "sha256:" + "1" * 64, REFERENCE),
        Keyring.derive(b"A" * 32, "sha256:" + "0" * 64, REFERENCE, namespace="other"),
    ]
    assert len({k.key for k in (base, *others)}) == 4
    for bad in (lambda: Keyring.derive(b"short", "sha256:" + "0" * 64, REFERENCE),
                lambda: Keyring.derive(b"A" * 32, "sha256:xyz", REFERENCE),
                lambda: Keyring.derive(b"A" * 32, "sha256:" + "0" * 64, None)):
        with pytest.raises(ValueError):
            bad()


def test_retry_digests_are_distinct(spark, keyring):
    from veilwright.functions.digest import retry_digest

    df = spark.range(8).select(
        F.col("id"), retry_digest(keyring, keyed_digest(keyring, F.lit(b"x")), F.col("id").cast("int")).alias("h")
    )
    import hashlib
    import hmac

    base = hmac.new(keyring.key, b"x", hashlib.sha256).digest()
    for row in df.collect():
        want = base if not row["id"] else hmac.new(
            keyring.key, keyring.retry_label + base + bytes([row["id"]]), hashlib.sha256).digest()
        assert row["h"] == want.hex()


def test_consistent_payload_excludes_table_and_params(spark, keyring):
    h = keyed_digest(keyring, consistent_payload("phone", F.lit("abc")))
    assert spark.range(1).select(h).first()[0] == scalar.digest(keyring, "phone", "abc").hex()
    assert len(digest_words(F.lit("0" * 64))) == 4


def test_random_moduli_match_big_integers(spark, keyring):
    import random

    from veilwright.functions.digest import fits_long

    draw = random.Random(7)
    moduli = [draw.randrange(1, 2 ** draw.randrange(1, 63)) << draw.choice((0, 0, 1, 5, 20)) for _ in range(40)]
    df = spark.range(50).select(keyed_digest(keyring, F.col("id").cast("string").cast("binary")).alias("h"))
    rows = df.select("h", *[digest_mod(F.col("h"), m).cast("decimal(38,0)").alias(f"m{i}") for i, m in enumerate(moduli)])
    for row in rows.collect():
        assert all(int(row[f"m{i}"]) == int(row["h"], 16) % m for i, m in enumerate(moduli))
    assert any(fits_long(m) for m in moduli)
