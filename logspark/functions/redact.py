"""Masks for addresses, credentials and e-mail names, as functions of a column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from logspark import fixed_values as V
from logspark.functions.text import bind, word_edges

Redactor = Callable[[Column], Column]

_SECRET = word_edges(V.SECRET_PAIR)
_SECRET_STRICT = word_edges(V.SECRET_PAIR_STRICT)
_AUTH = word_edges(V.AUTH_SCHEME)
_EMAIL = word_edges(V.EMAIL)
# Every address has one of these; a clock time has neither.
_MAYBE_IPV6 = r"::|(?:[0-9A-Fa-f]{1,4}:){6}"


def mask_secrets(text: Column) -> Column:
    """``token=abc`` becomes ``token=***`` for credential-like keys."""
    return F.regexp_replace(text, _SECRET, "$1$2***")


def mask_secrets_strict(text: Column) -> Column:
    """The same for keys in quotes (``"token": "x"``) and inside words (``user_token=x``) too."""
    return F.regexp_replace(text, _SECRET_STRICT, "$1$2***")


def mask_auth(text: Column) -> Column:
    """``Bearer abcdefgh`` becomes ``Bearer ***``."""
    return F.regexp_replace(text, _AUTH, "$1 ***")


def mask_email(text: Column) -> Column:
    """``jane@corp.com`` becomes ``***@corp.com``."""
    return F.regexp_replace(text, _EMAIL, "***@$1")


def mask_ipv4(text: Column, bits: int = V.IPV4_MASK_BITS) -> Column:
    """Zero the host part of every IPv4 address in a text."""
    if bits not in (8, 16, 24):
        raise ValueError("IPv4 addresses are masked to 8, 16 or 24 bits")
    kept = bits // 8
    before, after = V.IPV4_EDGES
    head = r"\.".join([V.OCTET] * kept)
    tail = rf"(?:\.{V.OCTET}){{{4 - kept}}}"
    return F.regexp_replace(text, f"{before}({head}){tail}{after}", "$1" + ".0" * (4 - kept))


def _groups(address: Column) -> Column:
    """The eight groups of an IPv6 address as lower-case hex without leading zeros."""
    dotted = F.regexp_extract(address, rf"({V.OCTET}(?:\.{V.OCTET}){{3}})\z", 1)
    octets = F.split(dotted, r"\.", -1)

    def pair(i: int) -> Column:
        high, low = (F.get(octets, F.lit(k)).try_cast("int") for k in (i, i + 1))
        return F.hex(high * 256 + low)

    # A dotted tail is two more groups.
    hexed = F.when(dotted != "", F.concat(
        F.regexp_replace(address, r"[0-9.]+\z", ""), pair(0), F.lit(":"), pair(2))).otherwise(address)

    def halves(text: Column) -> Column:
        sides = F.split(text, "::", -1)
        left, right = (
            F.filter(F.split(F.coalesce(F.get(sides, F.lit(i)), F.lit("")), ":", -1), lambda g: g != "") for i in (0, 1))
        zeros = F.array_repeat(F.lit("0"), F.lit(8) - F.size(left) - F.size(right))
        return F.transform(
            F.concat(left, zeros, right), lambda g: F.regexp_replace(F.lower(g), "^0+(?=.)", ""))

    return bind(hexed, halves)


def _network(groups: Column, ipv4_bits: int, ipv6_bits: int) -> Column:
    """The masked address in canonical text. The masked groups end the address
    and are its longest run of zeros, so they are what ``::`` stands for."""
    def number(i: int) -> Column:
        return F.conv(F.get(groups, F.lit(i)), 16, 10).cast("int")

    octets = [F.floor(number(6) / 256), number(6) % 256, F.floor(number(7) / 256)]
    kept = [octets[i].cast("string") if i < ipv4_bits // 8 else F.lit("0") for i in range(3)]
    mapped = F.concat_ws(".", F.concat(F.lit("::ffff:"), kept[0]), *kept[1:], F.lit("0"))
    head = F.array_join(F.slice(groups, 1, ipv6_bits // 16), ":")
    prefix = F.concat(F.regexp_replace(head, r"(?:^|:)0(?::0)*\z", ""), F.lit("::"))
    is_mapped = F.array_join(F.slice(groups, 1, 6), ":") == "0:0:0:0:0:ffff"
    return F.when(is_mapped, mapped).otherwise(prefix)


def _mask_token(token: Column, ipv4_bits: int, ipv6_bits: int) -> Column:
    """One address with its brackets, zone and port: the zone is dropped."""
    address = F.regexp_extract(token, r"^\[?([0-9A-Fa-f:.]+)", 1)
    network = bind(_groups(address), lambda groups: _network(groups, ipv4_bits, ipv6_bits))
    # A dotted tail that is no IPv4 address makes the whole token no address.
    invalid = F.contains(address, F.lit(".")) & ~address.rlike(rf":{V.OCTET}(?:\.{V.OCTET}){{3}}\z")
    bracketed = F.concat(F.lit("["), network, F.regexp_extract(token, r"(\](?::[0-9]{1,5})?)\z", 1))
    return F.when(invalid, token).when(token.startswith("["), bracketed).otherwise(network)


def mask_ipv6(
    text: Column, bits: int = V.IPV6_MASK_BITS, ipv4_bits: int = V.IPV4_MASK_BITS
) -> Column:
    """Zero all but the first ``bits`` of the IPv6 addresses in a text.

    ``::ffff:a.b.c.d`` stands for an IPv4 address and is masked like one.
    """
    if bits not in (16, 32, 48, 64):
        raise ValueError("IPv6 addresses are masked to 16, 32, 48 or 64 bits")

    def rewrite(value: Column) -> Column:
        between = F.split(value, V.IPV6_IN_TEXT, -1)
        masked = F.transform(
            F.regexp_extract_all(value, F.lit(V.IPV6_IN_TEXT), F.lit(0)),
            lambda token: _mask_token(token, ipv4_bits, bits))
        pieces = F.zip_with(between, masked, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))
        return F.when(value.rlike(_MAYBE_IPV6), F.array_join(pieces, "")).otherwise(value)

    return bind(text, rewrite)


def anonymise(
    text: Column, ipv4_bits: int = V.IPV4_MASK_BITS, ipv6_bits: int = V.IPV6_MASK_BITS
) -> Column:
    """Every mask in turn. A secret may hold what looks like an address, so
    secrets are blanked before addresses are looked for; of those, IPv6 comes
    first, or the dotted tail of a mapped one would be taken for IPv4."""
    text = mask_email(mask_auth(mask_secrets(text)))
    return mask_ipv4(mask_ipv6(text, ipv6_bits, ipv4_bits), ipv4_bits)


def anonymise_strict(
    text: Column, ipv4_bits: int = V.IPV4_MASK_BITS, ipv6_bits: int = V.IPV6_MASK_BITS
) -> Column:
    """:func:`anonymise` with credentials behind ``Bearer`` masked before keys, and with more keys."""
    text = mask_email(mask_secrets_strict(mask_auth(text)))
    return mask_ipv4(mask_ipv6(text, ipv6_bits, ipv4_bits), ipv4_bits)


def keep(text: Column) -> Column:
    """No redaction."""
    return text
