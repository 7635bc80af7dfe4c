"""Shared constants and parameter records."""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Names, word lists, thresholds and defaults that results depend
# on.  They are data, not logic.
# ---------------------------------------------------------------------------

FEATURES = (
    "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts",
    "bytes_per_pkt", "packet_ratio", "byte_ratio", "is_outbound",
    "duration", "src_port", "dst_port", "iat",
)
POOL_STATS = ("mean", "std", "min", "max")

SESSION_LEN = 20
INACTIVITY_TIMEOUT = 300.0
VAL_FRACTION = 0.15
TEST_FRACTION = 0.15
BENIGN, C2 = 0, 1

FPR_BUDGET_V1 = 0.005
FPR_BUDGET = 0.015
DAILY_FLOWS = 1_000_000

ZEEK_REQUIRED = (
    "ts", "id.orig_h", "id.resp_h", "id.orig_p", "id.resp_p", "proto", "duration",
    "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts", "conn_state", "history",
)

LOG_SCALED = ("orig_bytes", "resp_bytes", "bytes_per_pkt", "duration", "iat")

C2_LABELS_V1 = (
    "botnet", "c&c", "c2", "bot", "command and control",
    "neris", "rbot", "virut", "menti", "sogou", "murlo",
    "emotet", "trickbot", "qakbot",
)
C2_LABELS_V2 = C2_LABELS_V1 + (
    "sliver", "havoc", "cobalt strike", "cobaltstrike", "mythic",
    "brute ratel", "bruteratel", "metasploit", "meterpreter", "covenant", "poshc2",
    "beacon", "implant", "c2-beacon", "c2_beacon", "ta0011",
)
NON_C2_ATTACKS = (
    "ddos", "dos", "recon", "scanning", "bruteforce", "brute force",
    "web attack", "infiltration", "heartbleed", "bot-ddos", "mirai-ddos",
    "greip", "greeth", "udpplain", "syn", "udpflood",
)

C2_PATH_WORDS = (
    "ta0011", "command_and_control", "command-and-control", "c2", "c&c", "beacon", "implant",
    "t1071", "t1132", "t1001", "t1568", "t1573", "t1008", "t1105", "t1104",
    "t1095", "t1571", "t1572", "t1090", "t1219", "t1205", "t1102",
    "sliver", "havoc", "cobalt", "metasploit", "meterpreter", "mythic",
    "brute_ratel", "covenant", "poshc2", "emotet", "trickbot", "qakbot", "neris",
)
BENIGN_PATH_WORDS = ("benign", "normal", "legitimate", "clean", "baseline")

# (pattern, family): the first match wins; the technique pattern names its own family.
FAMILY_PATTERNS = (
    (r"cobalt[_\-]?strike", "cobalt_strike"), (r"brute[_\-]?ratel", "brute_ratel"),
    ("meterpreter", "metasploit"), ("sliver", "sliver"), ("havoc", "havoc"),
    ("metasploit", "metasploit"), ("mythic", "mythic"), ("covenant", "covenant"),
    ("poshc2", "poshc2"), ("emotet", "emotet"), ("trickbot", "trickbot"),
    ("qakbot", "qakbot"), ("neris", "neris"), ("rbot", "rbot"), ("virut", "virut"),
    ("menti", "menti"), ("sogou", "sogou"), ("murlo", "murlo"),
)
TECHNIQUE_PATTERN = r"(t1\d{3})"
DATASET_MARKERS = (("ctu13", "ctu13_mixed"), ("uwf", "uwf_mixed"), ("mcfp", "mcfp_mixed"))

# (keyword, family) of the keyword style.
FAMILY_KEYWORDS = (
    ("sliver", "sliver"), ("havoc", "havoc"), ("cobalt", "cobalt_strike"),
    ("metasploit", "metasploit"), ("meterpreter", "metasploit"), ("mythic", "mythic"),
    ("brute_ratel", "brute_ratel"), ("covenant", "covenant"), ("poshc2", "poshc2"),
    ("emotet", "emotet"), ("trickbot", "trickbot"), ("qakbot", "qakbot"),
)
KEYWORD_TECHNIQUE_PATTERN = r"(t\d{4})"

DATASET_SOURCES = (
    "ctu13", "uwf_zeekdata24", "mcfp_stratosphere", "cicids2018", "ciciot2023",
    "custom_lab", "unknown",
)
# ---------------------------------------------------------------------------

FLOW_KEY = ("src_ip", "dst_ip", "proto")
FLOW_ORDER = ("ts", "flow_id")
SESSION_KEY = FLOW_KEY + ("start_ts", "start_flow_id")


@dataclass(frozen=True)
class TimelineConfig:
    """Host timeline settings."""

    min_sessions: int = 10
    decay: float = 0.95
    max_history: int = 1000
    idle_hours: tuple[int, ...] = (0, 1, 2, 3, 4, 5)
    z_threshold: float = 3.0


@dataclass(frozen=True)
class FusionConfig:
    """Weights (they sum to one) and cut-offs of the multi-signal risk score."""

    weights: dict[str, float] = field(default_factory=lambda: {
        "host_anomaly": 0.30, "behavioral": 0.25, "persistence": 0.15,
        "ml_score": 0.15, "tls_dns": 0.10, "beaconing": 0.05,
    })
    min_signals_for_high: int = 3
    high: float = 0.70
    medium: float = 0.40
    aligned_at: float = 0.5


@dataclass(frozen=True)
class SkewConfig:
    """When to split one key over several tasks.

    A key with more than ``hot_rows`` rows is cut into ordered slices of about ``slice_rows`` rows.
    Any number of keys may be hot.
    """

    hot_rows: int = 4_000_000
    slice_rows: int = 1_000_000


SKEW = SkewConfig()
