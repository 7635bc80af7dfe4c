"""Scalar column functions.  All of them stay inside Catalyst expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F, types as T

EPS = 1e-9


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(c: Column | str, default: float = 0.0) -> Column:
    """Text or number to double; anything that is not a number becomes ``default``."""
    value = col(c).cast("string").try_cast("double")
    return F.when(F.isnan(value), F.lit(float(default))).otherwise(F.coalesce(value, F.lit(float(default))))


def to_number_mixed(c: Column | str, default: float = 0.0) -> Column:
    """Like ``to_number`` but also reads ``0x..`` hexadecimal text."""
    text = F.lower(F.trim(col(c).cast("string")))
    digits = F.regexp_extract(text, r"^0x([0-9a-f]+)$", 1)
    as_hex = F.conv(F.when(digits != "", digits), 16, 10).try_cast("double")
    return F.when(text.startswith("0x"), F.coalesce(as_hex, F.lit(float(default)))) \
        .otherwise(to_number(text, default))


def finite(c: Column | str, default: float = 0.0) -> Column:
    """Null, NaN and infinities to ``default``."""
    value = col(c).cast("double")
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(bad, F.lit(float(default))).otherwise(value)


def clip(c: Column | str, low: float | None = None, high: float | None = None) -> Column:
    value = col(c)
    if low is not None:
        value = F.greatest(value, F.lit(float(low)))
    if high is not None:
        value = F.least(value, F.lit(float(high)))
    return value


def bytes_per_packet(ob: Column, rb: Column, op: Column, rp: Column) -> Column:
    return (ob + rb) / (op + rp + F.lit(EPS))


def guarded_ratio(a: Column, b: Column) -> Column:
    return a / (b + F.lit(EPS))


def ratio_or_zero(a: Column, b: Column, floor: float = 0.0) -> Column:
    """``a / b`` where ``b`` exceeds ``floor``, else 0."""
    return F.when(b > F.lit(floor), a / b).otherwise(F.lit(0.0))


def signed_log(c: Column | str) -> Column:
    value = col(c)
    return F.signum(value) * F.log1p(F.abs(value))


def hour_utc(c: Column | str) -> Column:
    """Hour of day of epoch seconds, independent of the session time zone; 0 if not representable."""
    ts = col(c)
    ok = ts.between(F.lit(-62135596800.0), F.lit(253402300799.0))
    return F.when(ok, F.pmod(F.floor(ts / 3600), F.lit(24))).otherwise(F.lit(0)).cast("int")


def session_byte_ratio(sent: Column | str = "total_orig_bytes", received: Column | str = "total_resp_bytes") -> Column:
    s, r = col(sent), col(received)
    return F.when(r < EPS, F.greatest(s, F.lit(0.0))).otherwise(s / r)


def epoch_seconds(c: Column | str, dtype: T.DataType) -> Column:
    """Timestamp column to fractional epoch seconds; a zone-less timestamp is read as UTC."""
    value = col(c)
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(value) / F.lit(1e6)
    if isinstance(dtype, T.TimestampNTZType):
        micros = (F.unix_date(F.to_date(value)).cast("bigint") * 86_400_000_000
                  + F.hour(value).cast("bigint") * 3_600_000_000 + F.minute(value).cast("bigint") * 60_000_000
                  + (F.extract(F.lit("SECOND"), value) * 1_000_000).cast("bigint"))
        return micros / F.lit(1e6)
    return value.cast("double")


# --- private addresses -----------------------------------------------------

# The address ranges that the standard library calls private (wider than RFC 1918), as
# patterns over address text.
_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_QUAD = rf"{_OCTET}(\.{_OCTET}){{3}}"
_HEX = "[0-9a-f]{1,4}"
PRIVATE_V4 = (r"^(0\.|10\.|127\.|169\.254\.|172\.(1[6-9]|2\d|3[01])\.|192\.0\.0\.|192\.0\.2\.|192\.168\.|"
              r"198\.1[89]\.|198\.51\.100\.|203\.0\.113\.|24\d\.|25[0-5]\.)")
PUBLIC_V4_INSIDE = ("192.0.0.9", "192.0.0.10")
VALID_V6 = "|".join((
    f"^({_HEX}:){{7}}{_HEX}$", f"^({_HEX}:){{1,7}}:$", f"^({_HEX}:){{1,6}}:{_HEX}$",
    f"^({_HEX}:){{1,5}}(:{_HEX}){{1,2}}$", f"^({_HEX}:){{1,4}}(:{_HEX}){{1,3}}$", f"^({_HEX}:){{1,3}}(:{_HEX}){{1,4}}$",
    f"^({_HEX}:){{1,2}}(:{_HEX}){{1,5}}$", f"^{_HEX}:(:{_HEX}){{1,6}}$", f"^:((:{_HEX}){{1,7}}|:)$"))
PRIVATE_V6 = "|".join((
    r"^[0:]*[01]?$", r"^[0:]*:0\.0\.0\.[01]$",               # ::/128, ::1/128
    r"^0{0,2}64:ff9b:0{0,3}1:",                               # 64:ff9b:1::/48
    rf"^0?100:(0{{1,4}}:){{3}}", rf"^0?100:(0{{1,4}}:){{0,2}}:({_HEX}(:{_HEX}){{0,3}})?$",  # 100::/64
    rf"^0?100:(0{{1,4}}:){{0,2}}:({_HEX}:){{0,2}}[0-9.]+$",
    r"^2001:(0{0,2}[0-9a-f]{1,2}|0?[01][0-9a-f]{2}|0{3}[0-9a-f])?:",  # 2001::/23
    r"^2001:0?db8:",                                          # 2001:db8::/32
    r"^2002:",                                                # 2002::/16
    r"^f[cd][0-9a-f]{2}:",                                    # fc00::/7
    r"^fe[89ab][0-9a-f]:",                                    # fe80::/10
))
PUBLIC_V6_INSIDE = "|".join((
    r"^2001:0{0,3}1:[0:]*:0{0,3}[12]$",                       # 2001:1::1/128, 2001:1::2/128
    r"^2001:0{0,3}3:",                                        # 2001:3::/32
    r"^2001:0{0,3}4:0?112:",                                  # 2001:4:112::/48
    r"^2001:0{0,2}2[0-9a-f]:",                                # 2001:20::/28
    r"^2001:0{0,2}3[0-9a-f]:",                                # 2001:30::/28
))
MAPPED_V4 = rf"^[0:]+:ffff:({_HEX}:{_HEX}|[0-9.]+)$"
PRIVATE_MAPPED_HEX = "|".join((
    rf":ffff:(0{{0,2}}[0-9a-f]{{1,2}}|0?a[0-9a-f]{{2}}|7f[0-9a-f]{{2}}|a9fe|ac1[0-9a-f]|c0a8|c61[23]|f[0-9a-f]{{3}}):{_HEX}$",
    r":ffff:c000:(0{0,2}[0-9a-f]{1,2}|0?2[0-9a-f]{2})$", r":ffff:c633:64[0-9a-f]{2}$", r":ffff:cb00:71[0-9a-f]{2}$"))
PUBLIC_MAPPED_HEX = r":ffff:c000:0{0,3}[9a]$"


def is_private_ipv4(c: Column | str) -> Column:
    """1 for a private IPv4 address, 0 for a public one or for text that is no IPv4 address."""
    ip = col(c)
    private = ip.rlike(PRIVATE_V4) & ip.rlike(f"^{_QUAD}$") & ~ip.isin(*PUBLIC_V4_INSIDE)
    return F.coalesce(private.cast("int"), F.lit(0))


def ipv6_text(c: Column | str) -> Column:
    """Lower-case IPv6 text without a zone; null for text without colons or that is no address."""
    text = F.split_part(F.lower(col(c)), F.lit("%"), F.lit(1))
    return F.when(col(c).contains(":"), F.when(F.regexp_replace(text, f":{_QUAD}$", ":0:0").rlike(VALID_V6), text))


def is_private_address(ip: Column | str, v6: Column | str) -> Column:
    """1 for a private address of either family; ``v6`` is the result of ``ipv6_text`` on ``ip``.

    A mapped IPv4 address gets the answer of that address.
    """
    ip, v6 = col(ip), col(v6)
    mapped = F.when(v6.contains("."), is_private_ipv4(F.substring_index(v6, ":", -1))).otherwise(
        (v6.rlike(PRIVATE_MAPPED_HEX) & ~v6.rlike(PUBLIC_MAPPED_HEX)).cast("int"))
    native = (v6.rlike(PRIVATE_V6) & ~v6.rlike(PUBLIC_V6_INSIDE)).cast("int")
    return F.when(v6.isNotNull(), F.when(v6.rlike(MAPPED_V4), mapped).otherwise(native)).otherwise(is_private_ipv4(ip))


# --- losses and decisions --------------------------------------------------

def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def focal_loss(logit: Column | str, y: Column | str, alpha: float = 0.5, gamma: float = 1.0) -> Column:
    """Binary focal loss of one row, stable for large logits."""
    if not 0.0 <= alpha <= 1.0:
        raise ValueError(f"alpha must be in [0, 1], got {alpha}")
    if gamma < 0.0:
        raise ValueError(f"gamma must be >= 0, got {gamma}")
    z, t = col(logit).cast("double"), col(y).cast("double")
    cross_entropy = F.greatest(z, F.lit(0.0)) - z * t + F.log1p(F.exp(-F.abs(z)))
    p = sigmoid(z)
    missed = F.when(t == 1.0, F.lit(1.0) - p).otherwise(p)
    weight = F.when(t == 1.0, F.lit(float(alpha))).otherwise(F.lit(1.0 - alpha))
    return weight * F.pow(missed, F.lit(float(gamma))) * cross_entropy


def predict_at(score: Column | str, threshold: float | Column) -> Column:
    cut = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (col(score) >= cut).cast("int")


def hash_order(sample_id: Column | str, seed: int = 42) -> Column:
    """Repeatable pseudo-random order key of a row."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), col(sample_id).cast("string")))
