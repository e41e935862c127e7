import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from logspark.functions import redact as R


def apply(spark, fn, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r[0] for r in df.select("i", fn(F.col("t")).alias("o")).orderBy("i").select("o").collect()]


def expected_v6(address, bits=48, v4_bits=24):
    mapped = address.ipv4_mapped
    if mapped is not None:
        return f"::ffff:{ipaddress.ip_network(f'{mapped}/{v4_bits}', strict=False).network_address}"
    return str(ipaddress.ip_network(f"{address}/{bits}", strict=False).network_address)


@pytest.mark.parametrize("bits, v4_bits", [(48, 24), (64, 16), (32, 8), (16, 24)])
def test_ipv6_agrees_with_ipaddress(spark, bits, v4_bits):
    rnd = random.Random(bits)
    inputs, expected = [], []
    for _ in range(400):
        number = rnd.getrandbits(128)
        for _ in range(rnd.randrange(6)):
            number &= ~(0xFFFF << (16 * rnd.randrange(8)))
        if rnd.random() < 0.15:
            number = (0xFFFF << 32) | rnd.getrandbits(32)
        address = ipaddress.IPv6Address(number)
        written = rnd.choice([str(address), address.exploded, str(address).upper()])
        if address.ipv4_mapped is not None and rnd.random() < 0.5:
            written = f"::ffff:{address.ipv4_mapped}"
        masked = expected_v6(address, bits, v4_bits)
        shape = rnd.choice(["from {} at 13:55:36", "[{}]:443", "({}), {}"])
        inputs.append(shape.format(written, written + rnd.choice(["", "%eth0"])))
        expected.append(shape.format(masked, masked))
    assert apply(spark, lambda c: R.mask_ipv6(c, bits, v4_bits), inputs) == expected


def test_ipv6_that_is_none(spark):
    same = ["13:55:36", "a::b::c:", "::ffff:192.0.2.300", "::ffff:192.0.02.1", "12345::1", "", None, "x::1", "::1x"]
    assert apply(spark, R.mask_ipv6, same) == same
    assert apply(spark, R.mask_ipv6, ["[::1]:123456", "fe80::1%eth0.1", "[::1]x"]) == [
        "[::]:123456", "fe80::", "[::1]x".replace("::1", "::")]


def test_ipv4(spark):
    pairs = {
        "203.0.113.47": "203.0.113.0", "10.0.0.5 10.0.0.6": "10.0.0.0 10.0.0.0", "ip:10.0.0.5": "ip:10.0.0.5",
        "at 10.0.0.5.": "at 10.0.0.5.", "300.1.1.1": "300.1.1.1", "01.1.1.1": "01.1.1.1", "1.2.3.4.5": "1.2.3.4.5",
        "(8.8.8.8)": "(8.8.8.0)", "v1.2.3.4": "v1.2.3.4",
    }
    assert apply(spark, R.mask_ipv4, list(pairs)) == list(pairs.values())
    assert apply(spark, lambda c: R.mask_ipv4(c, 16), ["1.2.3.4"]) == ["1.2.0.0"]
    with pytest.raises(ValueError):
        R.mask_ipv4(F.lit("x"), 20)


def test_secrets_schemes_and_mail(spark):
    pairs = {
        "?token=1&a=2": "?token=***&a=2",
        'PASSWORD: "a b", x': "PASSWORD: ***, x",
        "session_id='x y';sid=3": "session_id=***;sid=***",
        "user_token=1": "user_token=1",
        '"token":"x"': '"token":"x"',
        "étoken=1": "étoken=1",
        "x Bearer abcdefgh": "x Bearer ***",
        "Bearer short": "Bearer short",
        "Authorization: Bearer abcdefghij": "Authorization: *** abcdefghij",
        "jane.d@corp.com!": "***@corp.com!",
        "secret=10.0.0.1 10.0.0.1": "secret=*** 10.0.0.0",
        "plain text": "plain text",
    }
    assert apply(spark, R.anonymise, list(pairs)) == list(pairs.values())
    assert apply(spark, R.anonymise, [None, ""]) == [None, ""]
    assert apply(spark, R.keep, ["10.0.0.1"]) == ["10.0.0.1"]


STRICT = [
    ("Authorization: Bearer abcdefghij", "abcdefghij"), ('{"token": "abc"}', "abc"), ("user_token=abc", "abc"),
    ("PHPSESSID=x1; sid=abc", "abc"), ("password: 'a b'", "a b"),
]


def test_the_strict_redactor_masks_what_the_default_leaves(spark):
    from logspark.functions.redact import anonymise_strict

    df = spark.createDataFrame([(t,) for t, _ in STRICT], "t string")
    for (text, secret), r in zip(STRICT, df.select(anonymise_strict(F.col("t")).alias("m")).collect()):
        assert secret not in r.m and "***" in r.m, (text, r.m)
    plain = spark.createDataFrame([("nothing to hide here, 12:30",)], "t string")
    assert plain.select(anonymise_strict(F.col("t"))).first()[0] == "nothing to hide here, 12:30"
