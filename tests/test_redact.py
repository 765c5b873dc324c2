from __future__ import annotations

import base64
import hashlib
import hmac
import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden.functions import crypto
from lakewarden.operators import obligations as O
from lakewarden.operators import redact, scan


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_hmac_equals_python(spark):
    for key in (b"k", b"x" * 64, b"y" * 100):
        want = hmac.new(key, "é:v".encode(), hashlib.sha256).hexdigest()
        assert one(spark, crypto.hmac_sha256(key, F.encode(F.lit("é:v"), "UTF-8"))) == want


def test_key_stretch_is_rfc_5869():
    ikm = bytes.fromhex("0b" * 22)
    first, second = crypto.stretch_key(ikm, b"")
    okm = first + second
    # Published vector with empty salt and info.
    assert okm[:42].hex() == "8da4e775a563c18f715f802a063c5a31b8a11f5c5ee1879ec3454e5f3c738d2d9d201395faa4b61a96c8"


def test_cipher_is_aes_256_gcm(spark):
    # Published all-zero vector: key 32 zero bytes, IV 12 zero bytes, one zero block.
    sealed = F.aes_encrypt(F.lit(bytes(16)), F.lit(bytes(32)), F.lit("GCM"), F.lit("DEFAULT"), F.lit(bytes(12)))
    assert one(spark, F.hex(sealed))[24:].lower() == "cea7403d4d606b6e074ec5d3baf39d18d0d1c8a799996bf0265b98b5d48ab919"


def test_tokens(spark):
    key, old = b"current key", b"retired key"
    label, value = F.lit("pii.email"), F.lit("ann@é.org")
    token = one(spark, crypto.token(label, value, key))
    raw = base64.urlsafe_b64decode(token[4:] + "=" * (-len(token[4:]) % 4))
    assert token.startswith("tok_") and raw[0] == 1
    prf, _ = crypto.stretch_key(key)
    nonce = hmac.new(prf, "pii.email\0ann@é.org".encode(), hashlib.sha256).digest()[:12]
    assert raw[1:13] == nonce
    assert one(spark, crypto.detoken(F.lit(token), key)) == "ann@é.org"
    older = one(spark, crypto.token(label, value, old))
    assert older != token
    assert one(spark, crypto.detoken(F.lit(older), key)) is None
    assert one(spark, crypto.detoken(F.lit(older), key, [old])) == "ann@é.org"
    for junk in ("", "tok_", "tok_!!!!", "x" + token, token[:-2], token[:-4] + "AAAA"):
        assert one(spark, crypto.detoken(F.lit(junk), key)) is None
    long = F.repeat(F.lit("é"), F.lit(2049))
    assert one(spark, crypto.token(label, long, key, max_bytes=4096)) is None
    assert one(spark, crypto.detoken(crypto.token(label, long, key), key)) == "é" * 2049


def test_canonical_json_equals_python(spark):
    values = ["plain", 'quote " and \\', "tab\tnew\nline", "é ß", "😀", "\x01\x1f\x7f", "", "/"]
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    got = rows.select("v", crypto.json_string(F.col("v")).alias("j")).collect()
    assert all(r.j == json.dumps(r.v) for r in got)
    shape = T.StructType.fromDDL("b string, a array<int>, c map<string,boolean>, d string, e struct<z:int,y:double>")
    data = [("x", [1, 2], {"k2": True, "k1": False}, None, (1, 0.5))]
    row = spark.createDataFrame(data, shape)
    whole = row.select(crypto.canonical_json(F.struct("*"), shape).alias("j")).first().j
    want = {"b": "x", "a": [1, 2], "c": {"k2": True, "k1": False}, "d": None, "e": {"z": 1, "y": 0.5}}
    assert whole == json.dumps(want, sort_keys=True, separators=(",", ":"))


def test_strategies(spark):
    v, label = F.lit("4111-1111-1111-1111"), F.lit("pci.card_number")
    assert one(spark, redact.mask(label)) == "[REDACTED:pci.card_number]"
    assert one(spark, redact.partial(v, F.lit(4))) == "****-****-****-1111"
    assert one(spark, redact.partial(F.lit("ab"), F.lit(0))) == "**"
    assert one(spark, redact.partial(F.lit("ab"), F.lit(9))) == "ab"
    digest = hmac.new(b"k", b"pci.card_number:4111-1111-1111-1111", hashlib.sha256).hexdigest()
    assert one(spark, redact.hashed(label, v, F.lit(8), b"k")) == f"<pci.card_number:{digest[:8]}>"
    seed = hmac.new(b"k", b"synth:pii.mac_address:aB-1", hashlib.sha256).digest()
    shaped = one(spark, redact.synthetic(F.lit("pii.mac_address"), F.lit("aB-1"), b"k"))
    assert shaped == f"xx-{seed[3] % 10}"
    assert one(spark, redact.synthetic(F.lit("pii.phone"), v, b"k")).startswith("+1555")


def test_text_is_rewritten_and_the_rest_kept(spark):
    rows = spark.createDataFrame([(1, "ann@example.com paid with 4111 1111 1111 1111 from 85.1.2.3 😀.")], "id int, t string")
    rules = O.literal(
        [
            {"type": "redact", "labels": ["pci"], "strategy": "partial"},
            {"type": "redact", "labels": ["pii.email", "pci"], "strategy": "mask"},
        ]
    )
    row = redact.redact_text(rows, "t", rules).first()
    assert row.redacted == "[REDACTED:pii.email] paid with **** **** **** 1111 from 85.1.2.3 😀."
    assert [(e.label, e.strategy) for e in row.edits] == [("pii.email", "mask"), ("pci.card_number", "partial")]
    assert [u.label for u in row.unhandled] == ["pii.ip_address"]


def test_tokens_without_a_key_fail(spark):
    rows = spark.createDataFrame([(1, "ann@example.com")], "id int, t string")
    rules = O.literal([{"type": "redact", "labels": ["*"], "strategy": "tokenize"}])
    try:
        redact.redact_text(rows, "t", rules).collect()
    except Exception as wrong:
        assert "no tokenisation key" in str(wrong)
    else:
        raise AssertionError("a token was asked for without a key and nothing failed")


def test_json_keeps_its_shape(spark):
    body = '{"n":1.5,"a":[null,true,{"mail":"x ann@example.com"}],"k\\"q":"no","e":{}}'
    rows = spark.createDataFrame([(1, body), (2, '{"clean": 1}'), (3, "not json")], "id int, j string")
    rules = O.literal([{"type": "redact", "labels": ["pii"], "strategy": "drop"}])
    out = {r.id: r.j for r in redact.redact_structured(rows, "j", ["id"], rules).collect()}
    assert json.loads(out[1]) == {"n": 1.5, "a": [None, True, {"mail": "x "}], 'k"q': "no", "e": {}}
    assert out[2] == '{"clean": 1}' and out[3] == "not json"


def test_context_scrub(spark):
    c = F.create_map(F.lit("API_KEY"), F.lit("x"), F.lit("n"), F.repeat(F.lit("y"), F.lit(600)))
    out = one(spark, redact.scrub_context(c))
    assert out["API_KEY"] == "[dropped]" and out["n"] == "y" * 512 + "..."


def test_structured_rewrite_is_spread_and_scans_once(spark, sf):
    """A small file's trees are walked by all cores, and no filter holds a copy of the scan."""
    rows = spark.read.parquet(f"{sf}/customer.parquet").select(
        "c_custkey", F.concat(F.lit('{"a":{"b":"user'), "c_custkey", F.lit('@mail.example.com"},"n":1}')).alias("body")
    )
    rule = O.literal([{"type": "redact", "labels": ["pii.email"], "strategy": "mask"}])
    out = redact.redact_structured(rows, "body", ["c_custkey"], rule)
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [line for line in plan if line.strip(" :+-").startswith("Filter") and "regexp" in line]
    assert any("Repartition" in line for line in plan)
    assert any("Repartition" in line for line in scan.leaf_table(rows, "body", ["c_custkey"])._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert {r.body for r in out.select("body").distinct().collect()} == {'{"a":{"b":"[REDACTED:pii.email]"},"n":1}'}
