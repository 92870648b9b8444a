"""Configuration of a search, and the flag set of a row."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

# The flags, in the order in which results show them.
FLAGS = (
    "Waveforms", "Keep", "DualMono", "Manual", "Replace", "Duration", "InvalidPath", "FileTags", "Tags", "Compare", "SimilarAudio",
    "SimilarFilename", "Basic", "All",
)
BIT = {name: 1 << i for i, name in enumerate(FLAGS)}

# Editor suffixes of processed files.
TAGS = (
    "-1eqa_", "-6030_", "-7eqa_", "-A2sA_", "-A44m_", "-A44s_", "-Alt7S_", "-ASMA_", "-AVrP_", "-AVrT_", "-AVSt_", "-Altvrb8_", "-DUPL_",
    "-DVerb_", "-GAIN_", "-Gain_", "-M2DN_", "-NORM_", "-NYCT_", "-PiSh_", "-PnT2_", "-PnTPro_", "-ProQ2_", "-PSh_", "-RVRS_", "-RX7Cnct_",
    "-spce_", "-TCEX_", "-TiSh_", "-TmShft_", "-VariFi_", "-VlhllVV_", "-VSPD_", "-VitmnMn_", "-VtmnStr_", "-X2mA_", "-X2sA_", "-XForm_",
    "-Z2N5_", "-Z2S5_", "-Z4n2_", "-ZXN5_",
)

# The user-visible names of the searches and the flag each one sets; filters of results by search.
SEARCHES = {
    "basic": "Basic", "filename": "SimilarFilename", "audiosuite": "Tags", "waveform": "Waveforms", "dual_mono": "DualMono",
    "filetags": "FileTags", "invalidpath": "InvalidPath", "duration": "Duration", "dbcompare": "Compare",
}
FILTER_ALIASES = {"audiosuite": ("Tags",), "dual_mono": ("DualMono",), "filename": ("SimilarFilename",), "waveform": ("Waveforms", "SimilarAudio")}


def has(flags: Column, name: str) -> Column:
    return flags.bitwiseAND(F.lit(BIT[name])) != 0


def add(flags: Column, *names: str) -> Column:
    return flags.bitwiseOR(F.lit(sum(BIT[n] for n in names)))


def drop(flags: Column, *names: str) -> Column:
    return flags.bitwiseAND(F.lit(~sum(BIT[n] for n in names)))


def shown(flags: Column) -> Column:
    """The flags' names as an array, in the order in which results show them."""
    return F.filter(F.array(*(F.when(has(flags, n), F.lit(n)) for n in FLAGS)), lambda x: x.isNotNull())


def shown_text(flags: Column) -> Column:
    return F.concat_ws(",", *(F.when(has(flags, n), F.lit(n)) for n in FLAGS))


@dataclass(frozen=True)
class Rule:
    """One line of a preservation order. operator: Largest, Smallest, Is, IsNot, IsEmpty, IsNotEmpty, Contains, DoesNotContain."""

    column: str
    operator: str
    variable: str = ""


# The default preservation order.
DEFAULT_ORDER = (
    Rule("description", "IsNotEmpty"),
    Rule("pathname", "DoesNotContain", "Audio Files"),
    Rule("pathname", "Contains", "LIBRARIES"),
    Rule("pathname", "Contains", "LIBRARY"),
    Rule("pathname", "Contains", "/LIBRARY"),
    Rule("pathname", "Contains", "LIBRARY/"),
    Rule("duration", "Largest"),
    Rule("channels", "Largest"),
    Rule("samplerate", "Largest"),
    Rule("bitdepth", "Largest"),
    Rule("bwdate", "Smallest"),
    Rule("scanneddate", "Smallest"),
)


@dataclass(frozen=True)
class Enabled:
    """Which searches run."""

    basic: bool = False
    filename: bool = False
    audiosuite: bool = False
    waveform: bool = False
    dual_mono: bool = False
    filetags: bool = False
    invalidpath: bool = False
    duration: bool = False
    dbcompare: bool = False
    min_dur: float = 0.5

    @classmethod
    def of(cls, algorithms: list[dict] | dict[str, bool], min_dur: float = 0.5) -> Enabled:
        """From a list of ``{"id", "enabled"}`` or a map. Without ``basic`` there is no ``audiosuite``."""
        on = algorithms if isinstance(algorithms, dict) else {a["id"]: bool(a.get("enabled")) for a in algorithms}
        on = {k: bool(on.get(k)) for k in SEARCHES}
        return cls(**on | {"audiosuite": on["audiosuite"] and on["basic"], "min_dur": min_dur})


@dataclass(frozen=True)
class Preferences:
    match_criteria: tuple[str, ...] = ("filename", "channels", "duration")
    preservation_order: tuple[Rule, ...] = DEFAULT_ORDER
    tags: tuple[str, ...] = TAGS
    autoselects: tuple[str, ...] = ()
    ignore_filetype: bool = False
    waveform_search_type: str = "Exact"
    similarity_threshold: int = 80
    batch_size: int = 1000
    fetch_waveforms: bool = True
    strict_smallest: bool = False
    scaled_ms: bool = False

    def columns(self) -> list[str]:
        """Catalog columns that criteria and rules need, each once."""
        return list(dict.fromkeys([*self.match_criteria, *(r.column for r in self.preservation_order)]))

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Preferences:
        """Saved preferences over the defaults; names that are not known are ignored."""
        raw = {k: v for k, v in json.loads(text).items() if k in {f.name for f in fields(cls)}}
        for k, v in raw.items():
            if isinstance(v, list):
                raw[k] = tuple(Rule(**x) if isinstance(x, dict) else x for x in v)
        return replace(cls(), **raw)


def load_presets(text: str) -> dict[str, tuple[Enabled, Preferences]]:
    """Named presets from JSON, ``{name: {"enabled": {...}, "preferences": {...}}}``; what a preset leaves out is the default."""
    out = {}
    for name, p in json.loads(text).items():
        on = dict(p.get("enabled", {}))
        least = on.pop("min_dur", Enabled.min_dur)
        out[name] = Enabled.of(on, least), Preferences.from_json(json.dumps(p.get("preferences", {})))
    return out


def save_presets(presets: dict[str, tuple[Enabled, Preferences]]) -> str:
    return json.dumps({name: {"enabled": asdict(e), "preferences": asdict(p)} for name, (e, p) in presets.items()})


def add_tags(tags: tuple[str, ...], more: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(dict.fromkeys([*tags, *more]))


def remove_tags(tags: tuple[str, ...], less: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(t for t in tags if t not in set(less))


def move_tags(chosen: tuple[str, ...], source: tuple[str, ...], to: tuple[str, ...]) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """``source`` without and ``to`` with the chosen tags of ``source``."""
    moved = tuple(t for t in source if t in set(chosen))
    return remove_tags(source, moved), add_tags(to, moved)


