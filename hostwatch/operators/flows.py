"""From raw flow columns to the canonical flow table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from hostwatch.config import FEATURES, FLOW_KEY, FLOW_ORDER, SKEW, SkewConfig
from hostwatch.functions import scalars as S
from hostwatch.operators.ordered import KeyedRows

# Column names of the supported log formats, by canonical name.
ALIASES = {
    "ts": ("ts", "StartTime", "start_time"),
    "src_ip": ("src_ip", "id.orig_h", "SrcAddr"),
    "dst_ip": ("dst_ip", "id.resp_h", "DstAddr"),
    "src_port": ("src_port", "id.orig_p", "Sport"),
    "dst_port": ("dst_port", "id.resp_p", "Dport"),
    "proto": ("proto", "Proto"),
    "duration": ("duration", "Dur"),
    "orig_bytes": ("orig_bytes", "SrcBytes"),
    "resp_bytes": ("resp_bytes", "DstBytes"),
    "orig_pkts": ("orig_pkts",),
    "resp_pkts": ("resp_pkts",),
    "tot_bytes": ("tot_bytes", "TotBytes"),
    "tot_pkts": ("tot_pkts", "TotPkts"),
    "label_text": ("label_text", "Label"),
}
ENDPOINTS = ("ts",) + FLOW_KEY

# Upper (and lower) limits of the clipped features.
LIMITS = {
    "orig_bytes": (None, 1e9), "resp_bytes": (None, 1e9), "bytes_per_pkt": (None, 65535),
    "packet_ratio": (None, 1000), "byte_ratio": (None, 1000), "duration": (None, 3600),
    "src_port": (0, 65535), "dst_port": (0, 65535), "iat": (0, 3600),
}


def require_columns(df: DataFrame, names: Sequence[str], what: str = "DataFrame") -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing required columns: {missing}")
    return df


def canonical_names(df: DataFrame, aliases: dict[str, tuple[str, ...]] = ALIASES) -> DataFrame:
    """Rename known aliases; of several aliases of one name the first non-null value is used."""
    known = {a for group in aliases.values() for a in group}
    renamed = []
    for name, group in aliases.items():
        present = [F.col(f"`{a}`") for a in group if a in df.columns]
        if present:
            renamed.append((present[0] if len(present) == 1 else F.coalesce(*present)).alias(name))
    return df.select(*renamed, *[F.col(f"`{c}`") for c in df.columns if c not in known])


def parse_time(c: Column | str, formats: Sequence[str] = ("yyyy/MM/dd HH:mm:ss[.SSSSSS]", "yyyy-MM-dd HH:mm:ss[.SSSSSS]",
                                                         "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]")) -> Column:
    """Epoch seconds: numbers stay as they are, date text is read as UTC and floored to seconds."""
    text = F.trim(S.col(c).cast("string"))
    number = text.try_cast("double")
    ntz = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in formats])
    return F.coalesce(number, F.floor(S.epoch_seconds(ntz, T.TimestampNTZType())).cast("double"))


def infer_from_totals(df: DataFrame) -> DataFrame:
    """Derive missing per-direction volumes from byte and packet totals."""
    out = df
    if "resp_bytes" not in out.columns and "tot_bytes" in out.columns:
        sent = S.to_number("orig_bytes") if "orig_bytes" in out.columns else F.lit(0.0)
        out = out.withColumn("resp_bytes", F.greatest(S.to_number("tot_bytes") - sent, F.lit(0.0)))
    if "orig_pkts" not in out.columns and "tot_pkts" in out.columns:
        total = S.to_number("tot_pkts")
        out = out.withColumns({"orig_pkts": F.ceil(total / 2).cast("double"),
                               "resp_pkts": F.floor(total / 2).cast("double")})
    return out


def standardize_flows(df: DataFrame, aliases: dict[str, tuple[str, ...]] = ALIASES) -> DataFrame:
    """Alias names, parse time, normalise endpoints.  Rows without a usable time or endpoint go."""
    out = require_columns(canonical_names(df, aliases), ENDPOINTS, "flow table")
    out = out.withColumns({
        "ts": parse_time("ts"),
        "src_ip": F.trim(F.col("src_ip").cast("string")),
        "dst_ip": F.trim(F.col("dst_ip").cast("string")),
        "proto": F.lower(F.trim(F.col("proto").cast("string"))),
    })
    return infer_from_totals(drop_unusable(out))


def drop_unusable(df: DataFrame) -> DataFrame:
    """Keep rows that have a time and a complete key."""
    return df.filter(" AND ".join(f"{c} IS NOT NULL" for c in ENDPOINTS))


def clean_flows(df: DataFrame, pkt_floor: float = 0.0, drop_empty: bool = True) -> DataFrame:
    """Numeric volumes with defaults, negative values to zero, flows without packets dropped."""
    def number(name: str, default: float = 0.0, floor: float = 0.0) -> Column:
        if name not in df.columns:
            return F.lit(float(default))
        return F.greatest(S.to_number_mixed(name, default), F.lit(float(floor)))

    out = df.withColumns({
        "duration": number("duration"),
        "orig_bytes": number("orig_bytes"),
        "resp_bytes": number("resp_bytes"),
        "orig_pkts": number("orig_pkts", pkt_floor, pkt_floor),
        "resp_pkts": number("resp_pkts"),
        "src_port": S.to_number_mixed("src_port") if "src_port" in df.columns else F.lit(0.0),
        "dst_port": S.to_number_mixed("dst_port") if "dst_port" in df.columns else F.lit(0.0),
    })
    return out.filter(F.col("orig_pkts") + F.col("resp_pkts") > 0) if drop_empty else out


def derive_ratios(df: DataFrame) -> DataFrame:
    ob, rb, op, rp = (F.col(c) for c in ("orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts"))
    return df.withColumns({"bytes_per_pkt": S.bytes_per_packet(ob, rb, op, rp),
                           "packet_ratio": S.guarded_ratio(op, rp), "byte_ratio": S.guarded_ratio(ob, rb)})


def flag_private(df: DataFrame, **flags: str) -> DataFrame:
    """Add ``name=ip_column``: 1 for a private address of either family, 0 for any other text.

    Works in steps so that the IPv6 text is computed once; it is null for IPv4 rows.
    """
    out = df.withColumns({f"_v6_{n}": S.ipv6_text(ip) for n, ip in flags.items()})
    out = out.withColumns({n: S.is_private_address(ip, f"_v6_{n}") for n, ip in flags.items()})
    return out.drop(*[f"_v6_{n}" for n in flags])


def with_direction(df: DataFrame) -> DataFrame:
    """1.0 for flows from a private source to a destination that is not private."""
    out = flag_private(df, _inside="src_ip", _target="dst_ip")
    outbound = (F.col("_inside") == 1) & (F.col("_target") == 0)
    return out.withColumn("is_outbound", outbound.cast("double")).drop("_inside", "_target")


def inter_arrival(rows: KeyedRows) -> KeyedRows:
    """Add ``iat``, ``iat_delta`` and ``byte_delta`` to rows ordered by flow key and time."""
    rows = rows.lag(_ts="ts", _bytes="orig_bytes")
    zero = F.lit(0.0)
    rows = rows.with_columns({
        "iat": F.greatest(F.coalesce(F.col("ts") - F.col("_ts"), zero), zero),
        "byte_delta": F.coalesce(F.col("orig_bytes") - F.col("_bytes"), zero)}).lag(_iat="iat")
    rows = rows.with_columns({"iat_delta": F.coalesce(F.col("iat") - F.col("_iat"), zero)})
    return rows.drop("_ts", "_bytes", "_iat")


def with_inter_arrival(df: DataFrame, keys: Sequence[str] = FLOW_KEY, order: Sequence[str] = FLOW_ORDER,
                       skew: SkewConfig | None = SKEW) -> DataFrame:
    """Gap to the previous flow of the key, and the changes of gap and sent bytes."""
    return inter_arrival(KeyedRows.plan(df, keys, order, skew=skew)).done()


def feature_matrix(df: DataFrame, clip: bool = True, keep: Sequence[str] = ENDPOINTS) -> DataFrame:
    """Ordered projection of the flow features, finite and (optionally) within their limits."""
    require_columns(df, FEATURES, "flow features")

    def feature(name: str) -> Column:
        value = S.finite(name)
        return S.clip(value, *LIMITS[name]) if clip and name in LIMITS else value

    return df.select(*keep, *[feature(n).alias(n) for n in FEATURES])


def row_identity(df: DataFrame) -> Column:
    """Repeatable tie-break of rows that come without an id: equal only for equal rows."""
    return F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in sorted(df.columns)])
