"""IP address rules: normalising, trust lists, client resolution and masking."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from footfall.functions.text import let, present

_V4_TEXT = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_HEXTETS = r"(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?"

Trust = bool | int | str | list[str] | None


def _strip_port(ip: Column) -> Column:
    """Drop the port of '[v6]:port' and 'v4:port'."""
    return (
        F.when(
            ip.startswith("[") & ip.contains("]"),
            F.regexp_replace(ip, r"^\[([^\]]+)\].*$", "$1"),
        )
        .when(ip.rlike(rf"^{_V4_TEXT}:\d+$"), F.substring_index(ip, ":", 1))
        .otherwise(ip)
    )


def normalize_ip(ip: Column) -> Column:
    """Bare lower-case address; '' when there is none."""
    bare = _strip_port(F.trim(ip))
    return F.coalesce(F.lower(F.regexp_replace(bare, "^::ffff:", "")), F.lit(""))


def is_valid_ip(ip: Column) -> Column:
    """A well-formed IPv4 or IPv6 address (IPv6 may carry a zone or end in IPv4 form)."""
    def v6(plain: Column) -> Column:
        groups = F.size(F.filter(F.split(plain, ":"), lambda h: h != ""))
        full = plain.rlike(r"^[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){7}$")
        return full | (plain.rlike(rf"^{_HEXTETS}::{_HEXTETS}$") & (groups <= 7))

    bare = F.when(ip.contains("%"), F.regexp_replace(ip, "%[0-9A-Za-z.:-]+$", "")).otherwise(ip)
    hex_only = F.when(bare.contains("."), F.regexp_replace(bare, rf"(?<=:){_V4}$", "0:0")).otherwise(bare)
    known = F.when(ip.contains(":"), let(F.lower(hex_only), v6)).otherwise(ip.rlike(rf"^{_V4}$"))
    return F.coalesce(known, F.lit(False))


def v4_number(ip: Column) -> Column:
    """IPv4 as a number, NULL unless there are four parts from 0 to 255."""

    def total(parts: Column) -> Column:
        octets = [F.get(parts, F.lit(i)) for i in range(4)]
        return octets[0] * 16777216 + octets[1] * 65536 + octets[2] * 256 + octets[3]

    def loose_part(text: Column) -> Column:
        # Text after a part's digits is ignored.
        digits = F.regexp_extract(text, r"^\s*0*(\d{1,3})(?!\d)", 1)
        return F.when(digits.rlike(rf"^{_OCTET}$"), digits.cast("bigint"))

    def loose_total(parts: Column) -> Column:
        return F.when(F.size(parts) == 4, total(parts))

    parts = F.split(ip, r"\.")
    return F.when(ip.rlike(rf"^{_V4}$"), let(parts.cast("array<bigint>"), total)).when(
        ip.rlike(r"^\s*\d+[^.]*\.\s*\d"), let(F.transform(parts, loose_part), loose_total)
    )


_NO_TEXT = "array<string>"


def _pieces(text: Column) -> Column:
    return F.when(present(text), F.split(text, ":")).otherwise(F.array().cast(_NO_TEXT))


def _fill_gap(left: Column, right: Column) -> Column:
    """Eight groups, with zeros between the sides; more than eight when there are too many."""
    missing = F.greatest(8 - F.size(left) - F.size(right), F.lit(0))
    return F.concat(left, F.array_repeat(F.lit("0"), missing), right)


def _four_digits(group: Column) -> Column:
    """A group's leading hex digits padded to four; NULL when none or out of range."""
    digits = F.regexp_extract(
        F.when(group == "", "0").otherwise(group), r"^\s*(?:0x)?0*([0-9a-f]+)", 1
    )
    return F.when((digits != "") & (F.length(digits) <= 4), F.lpad(digits, 4, "0"))


def v6_hex(ip: Column) -> Column:
    """IPv6 as 32 hex digits; a gap is filled with zeros, NULL when malformed."""

    def joined(groups: Column) -> Column:
        whole = (F.size(groups) == 8) & ~F.exists(groups, lambda g: g.isNull())
        return F.when(whole, F.array_join(groups, ""))

    def groups(halves: Column) -> Column:
        return F.when(
            F.size(halves) <= 2,
            F.transform(
                _fill_gap(_pieces(F.get(halves, 0)), _pieces(F.get(halves, 1))), _four_digits
            ),
        )

    return F.when(
        ip.contains(":"), let(let(F.split(F.lower(ip), "::"), groups), joined)
    )


def _describe(ip: Column, entries: list[str]) -> Column:
    """The forms of an address that checking it against ``entries`` needs."""
    networks = [entry for entry in entries if "/" in entry]
    v4 = any(":" not in network for network in networks)
    v6 = any(":" in network for network in networks)
    return F.struct(
        ip.alias("text"),
        (v4_number(ip) if v4 else F.lit(None).cast("bigint")).alias("v4"),
        (v6_hex(ip) if v6 else F.lit(None).cast("string")).alias("v6"),
    )


def _prefix_length(text: str | None, default: int) -> int | None:
    if text is None:
        return default
    digits = re.match(r"\s*(\d+)", text)
    return int(digits[1]) if digits and int(digits[1]) <= default else None


def _network_number(text: str) -> int | None:
    parts = [re.match(r"\s*(\d+)", p) for p in text.split(".")]
    if len(parts) != 4 or not all(p and int(p[1]) <= 255 for p in parts):
        return None
    return sum(int(p[1]) << (8 * (3 - i)) for i, p in enumerate(parts))


def _network_hex(text: str) -> str | None:
    """A network's 32 hex digits; a missing '::' counts as one at the end."""
    left, _, right = text.strip().lower().partition("::")
    before, after = ([g for g in half.split(":") if half] for half in (left, right))
    groups = before + ["0"] * (8 - len(before) - len(after)) + after
    if len(groups) != 8 or not all(re.fullmatch("[0-9a-f]{0,4}", g) for g in groups):
        return None
    return "".join(g.rjust(4, "0") for g in groups)


def _matches_entry(seen: Column, entry: str) -> Column:
    """Whether a described address falls under one trust-list entry."""
    if "/" not in entry:
        return seen["text"] == normalize_ip(F.lit(entry))
    network, prefix = entry.split("/")[:2]
    if ":" in entry:
        bits = _prefix_length(prefix, 128)
        if bits is None:
            return F.lit(False)
        own = _network_hex(network)
        if own is None:
            return F.lit(False)
        whole, rest = divmod(bits, 4)
        same = seen["v6"].isNotNull() & seen["v6"].startswith(own[:whole])
        if rest:
            # The digit that the prefix splits: those that share its leading bits.
            kept = int(own[whole], 16) >> (4 - rest)
            digits = [f"{d:x}" for d in range(16) if d >> (4 - rest) == kept]
            same = same & F.substring(seen["v6"], whole + 1, 1).isin(digits)
        return F.coalesce(same, F.lit(False))
    bits = _prefix_length(prefix, 32)
    if bits is None:
        return F.lit(False)
    own = _network_number(network)
    if own is None:
        return F.lit(False)
    low = own >> (32 - bits) << (32 - bits)
    return F.coalesce(seen["v4"].between(low, low + (1 << (32 - bits)) - 1), F.lit(False))


def is_trusted(seen: Column, entries: list[str]) -> Column:
    """Whether a described address is on the trust list."""
    listed = F.lit(False)
    for entry in entries:
        listed = listed | _matches_entry(seen, entry)
    return (seen["text"] != "") & listed


def ip_in_cidr(ip: Column, entries: list[str]) -> Column:
    """Whether an address equals an entry or lies in one of its networks (IPv4 and IPv6)."""
    listed = trust_entries(entries)
    return let(
        let(normalize_ip(ip), lambda bare: _describe(bare, listed)),
        lambda seen: is_trusted(seen, listed),
    )


def trust_entries(trust: str | list[str]) -> list[str]:
    listed = [trust] if isinstance(trust, str) else trust
    return [entry.strip() for entry in listed if entry.strip()]


def resolve_client_ip(remote: Column, forwarded: Column, trust: Trust) -> Column:
    """Client address from the peer and its ``X-Forwarded-For`` under a trust rule.

    ``trust`` is off (False/None), a number of hops (True means one) or a list of trusted
    addresses and networks. Anything doubtful falls back to the peer.
    """
    peer = normalize_ip(remote)
    if trust is False or trust is None:
        return peer
    hops = F.filter(
        F.transform(F.split(F.coalesce(forwarded, F.lit("")), ","), normalize_ip),
        lambda ip: ip != "",
    )
    if isinstance(trust, (bool, int, float)):
        back = max(1, int(trust))

        def picked(hops: Column) -> Column:
            return F.when(F.size(hops) >= back, F.get(hops, F.size(hops) - back))
    else:
        entries = trust_entries(trust)

        def picked(hops: Column) -> Column:
            outside = F.filter(
                F.transform(hops, lambda ip: _describe(ip, entries)), lambda seen: ~is_trusted(seen, entries)
            )
            last = F.try_element_at(outside, F.lit(-1))["text"]
            return F.when(ip_in_cidr(remote, entries), F.coalesce(last, F.get(hops, F.lit(0))))

    valid = let(let(hops, picked), lambda ip: F.when(is_valid_ip(ip), ip))
    return F.coalesce(F.when(present(forwarded), valid), peer)


def _mask_v6(clean: Column) -> Column:
    """The first 48 bits in short form; NULL when malformed."""

    def filled(half: Column) -> Column:
        return F.filter(_pieces(half), lambda g: g != "")

    def groups(halves: Column) -> Column:
        # An IPv4 ending is left out: only the first three groups survive masking anyway.
        tail = F.filter(filled(F.get(halves, 1)), lambda g: ~g.contains("."))
        left = filled(F.get(halves, 0))
        return F.when(F.size(halves) == 1, left).when(F.size(halves) == 2, _fill_gap(left, tail))

    def first_three(groups: Column) -> Column:
        return F.when(
            F.size(groups) == 8,
            F.transform(
                F.slice(groups, 1, 3),
                lambda g: F.regexp_extract(g, r"^(?:0x)?0*([0-9a-f]*)", 1),
            ),
        )

    def short(parts: Column) -> Column:
        zero_or = F.transform(parts, lambda g: F.when(g == "", "0").otherwise(g))
        text = F.concat(F.array_join(zero_or, ":"), F.lit("::"))
        return F.regexp_replace(F.regexp_replace(text, "(?::0)+::$", "::"), "^0::$", "::")

    halves = F.split(F.lower(clean), "::")
    return let(let(let(halves, groups), first_three), short)


def mask_ip(ip: Column) -> Column:
    """Anonymise: IPv4 keeps 24 bits, IPv6 keeps 48; other text is returned as it is."""

    def unmapped(bare: Column) -> Column:
        mapped = bare.rlike(r"(?i)^::ffff:.*\.")
        return F.when(mapped, F.regexp_replace(bare, r"(?i)^::ffff:", "")).otherwise(bare)

    def masked(clean: Column) -> Column:
        return (
            F.when(clean.rlike(rf"^{_V4_TEXT}$"), F.regexp_replace(clean, r"\d+$", "0"))
            .when(clean.contains(":"), _mask_v6(clean))
            .otherwise(clean)
        )

    plain_v4 = ip.rlike(rf"^{_V4_TEXT}$")
    return (
        F.when(ip.isNull() | (ip == ""), None)
        .when(plain_v4, F.regexp_replace(ip, r"\d+$", "0"))
        .otherwise(let(let(_strip_port(F.trim(ip)), unmapped), masked))
    )


def address_bits(ip: Column) -> Column:
    """The bits of an IPv4 ('4' and 32 of them) or IPv6 address ('6' and 128) as text; NULL for neither."""

    def of_hex(digits: Column) -> Column:
        groups = [F.lpad(F.conv(F.substring(digits, i, 4), 16, 2), 16, "0") for i in range(1, 33, 4)]
        return F.concat(F.lit("6"), *groups)

    v4 = F.when(~ip.contains(":"), F.concat(F.lit("4"), F.lpad(F.bin(v4_number(ip)), 32, "0")))
    return F.coalesce(v4, let(v6_hex(ip), of_hex))


def network_bits(entry: Column) -> Column:
    """The leading bits that an entry 'network/length' fixes, as in `address_bits`; NULL for anything else."""
    network, prefix = F.split_part(entry, F.lit("/"), F.lit(1)), F.split_part(entry, F.lit("/"), F.lit(2))
    is_v6 = network.contains(":")
    # A missing '::' counts as one at the end.
    open_ended = is_v6 & ~network.contains("::") & (F.size(F.split(network, ":")) < 8)
    whole = address_bits(F.trim(F.when(open_ended, F.concat(network, F.lit("::"))).otherwise(network)))
    length = F.try_to_number(F.regexp_extract(prefix, r"^\s*(\d{1,9})", 1), F.lit("999999999")).cast("int")
    most = F.when(is_v6, 128).otherwise(32)
    return F.when(entry.contains("/") & (length <= most), whole.substr(F.lit(1), length + 1))
