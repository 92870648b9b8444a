"""Registered queries of the core library and their DuckDB equivalents, over the catalog tables.

Each query runs on whole tables. Where no SQL is given, the tests hold the operator against a plain model.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.functions import fingerprints, paths
from tapewright.functions.durations import split_seconds
from tapewright.functions.values import compare_versions, rank_value
from tapewright.operators import dedupe, edit, landmarks, match, model, normalise_instants, views
from tapewright.operators.catalog_rows import visible_columns, working_rows
from tapewright.operators.model import Enabled, Preferences, Rule, shown_text
from tapewright.operators.search import search
from tapewright.operators.stage import Stage
from tapewright.sources import audio
from tapewright.streaming import incremental

FLAGSHIP = "search_pipeline"
QUERIES: dict = {}
SQL: dict[str, str] = {}

PLAIN = Preferences()
SIMILAR = Preferences(match_criteria=("filename",), ignore_filetype=True)
NAMES = Enabled(basic=True, filename=True, audiosuite=True)
FULL = Enabled(basic=True, filename=True, audiosuite=True, waveform=True, dual_mono=True, filetags=True, duration=True, dbcompare=True, invalidpath=True, min_dur=1.0)
FULL_PREFS = replace(SIMILAR, match_criteria=("filename", "channels"), autoselects=("_ZQ_", ".aif"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "justinmetadata")


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


# SQL pieces

SPACE = r"[\t-\r\x{85}\p{Z}]+"


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _trim(c: str) -> str:
    return rf"regexp_replace({c}, '\A{SPACE}|{SPACE}\z', '', 'g')"


def _any(c: str, parts) -> str:
    return "(" + (" or ".join(f"contains({c}, {_lit(p)})" for p in dict.fromkeys(parts)) or "false") + ")"


def _before(c: str, parts) -> str:
    return "case " + " ".join(f"when contains({c}, {_lit(p)}) then split_part({c}, {_lit(p)}, 1)" for p in dict.fromkeys(parts)) + f" else {c} end"


def _rows(prefs: Preferences, enabled: Enabled, source: str = "justinmetadata") -> str:
    """CTEs up to ``r0``: working rows with keep and one boolean for each flag."""
    names = ("wave", "dual", "repl", "dur", "inv", "ftag", "tag", "cmp", "simaudio", "simname", "basic")
    inv = "f.file_path is null" if enabled.invalidpath or enabled.dual_mono else "false"
    dur = f"coalesce({_seconds('duration')} < {enabled.min_dur}, false)" if enabled.duration else "false"
    ftag = _any("file_path", prefs.autoselects) if enabled.filetags and prefs.autoselects else "false"
    cmp_ = "file_name in (select filename from compare_catalog where filename is not null)" if enabled.dbcompare else "false"
    base = "base" if prefs.ignore_filetype else "base || '.' || ext"
    flags = {"inv": "_inv", "dur": "_dur", "ftag": "_ftag", "cmp": "_cmp"}
    return rf"""
with p1 as (select rowid as id, coalesce(filepath, '') as file_path, coalesce(duration, '') as duration, coalesce(description, '') as description,
    channels, bitdepth, samplerate, pathname, nullif(_fingerprint, '') as fingerprint, _dualmono, filename as c_filename, cast(channels as varchar) as c_channels,
    duration as c_duration, description as c_description, pathname as c_pathname, cast(samplerate as varchar) as c_samplerate, cast(bitdepth as varchar) as c_bitdepth,
    regexp_replace(coalesce(filepath, ''), '(?:/+\.?)+\z', '') as cut from {source}),
p2 as (select *, regexp_extract(cut, '([^/]*)\z', 1) as last from p1),
p3 as (select *, case when last not in ('', '.', '..') then last end as nm from p2),
p4 as (select *, coalesce(nm, 'Invalid Filename') as file_name, regexp_matches(nm, '(?s)\A.+\.[^.]*\z') as dotted from p3),
p5 as (select *, coalesce(case when dotted then regexp_extract(nm, '(?s)\A(.+)\.[^.]*\z', 1) else nm end, 'Invalid Filestem') as stem,
    coalesce(case when dotted then regexp_extract(nm, '\.([^.]*)\z', 1) end, 'Invalid Extension') as ext,
    case when cut = '' then 'Invalid Path' else regexp_replace(regexp_replace(cut, '[^/]*\z', ''), '(.)/+\z', '\1') end as parent from p4),
p6 as (select *, {_trim("stem")} as t0 from p5), p7 as (select *, {_before("t0", prefs.tags)} as t1 from p6),
p8 as (select *, {_before("t1", paths.COPIES)} as t2 from p7),
p9 as (select *, coalesce(nullif(regexp_extract(t2, '\A([^\n]+?)(?:\.(?:\p{{Nd}}+|M))*\z', 1), ''), t2) as base from p8),
q0 as (select p9.*, {base} as root, {inv} as _inv, {dur} as _dur, {ftag} as _ftag, {cmp_} as _cmp from p9
    left join (select distinct filepath as file_path from compare_catalog where filepath is not null) f using (file_path)),
r0 as (select *, not ({"_inv or " if enabled.invalidpath else ""}_dur or _ftag or _cmp) as keep, {", ".join(f"{flags.get(n, 'false')} as {n}" for n in names)} from q0)"""


def _seconds(c: str) -> str:
    n = r"'[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?'"
    head, rest = f"split_part({c}, ':', 1)", f"substr({c}, instr({c}, ':') + 1)"
    return f"case when instr({c}, ':') > 0 and regexp_full_match({head}, {n}) and regexp_full_match({rest}, {n}) then try_cast({head} as double) * 60 + try_cast({rest} as double) end"


SHOWN = """concat_ws(',', case when wave then 'Waveforms' end, case when keep then 'Keep' end, case when dual then 'DualMono' end, case when repl then 'Replace' end,
    case when dur then 'Duration' end, case when inv then 'InvalidPath' end, case when ftag then 'FileTags' end, case when tag then 'Tags' end, case when cmp then 'Compare' end,
    case when simaudio then 'SimilarAudio' end, case when simname then 'SimilarFilename' end, case when basic then 'Basic' end)"""


def _rank(c: str) -> tuple[str, str]:
    whole = rf"case when regexp_full_match({c}, '[+-]?\d+') then try_cast({c} as bigint) end"
    part = lambda i: rf"case when regexp_full_match(regexp_split_to_array({c}, '[:.]')[{i}], '[+-]?\d+') then try_cast(regexp_split_to_array({c}, '[:.]')[{i}] as bigint) end"
    n = f"len(regexp_split_to_array({c}, '[:.]'))"
    span = f"case when {n} = 3 then {part(1)} * 60000 + {part(2)} * 1000 + {part(3)} when {n} = 4 then {part(1)} * 3600000 + {part(2)} * 60000 + {part(3)} * 1000 + {part(4)} end"
    stamp = rf"case when regexp_full_match({c}, '\d{{4}}-\d{{1,2}}-\d{{1,2}} \d{{1,2}}:\d{{1,2}}:\d{{1,2}}') then cast(epoch(try_cast({c} as timestamp)) as bigint) end"
    kind = f"case when {whole} is not null then 0 when {span} is not null then 1 when {stamp} is not null then 2 else 0 end"
    return kind, f"coalesce({whole}, {span}, {stamp}, 0)"


def _rule(r: Rule, c: str) -> str:
    x = _lit(r.variable.lower())
    if r.operator == "Largest":
        return ", ".join(f"{k} desc" for k in _rank(c))
    if r.operator == "Smallest":
        return ""
    test = {"Is": f"lower({c}) = {x}", "IsNot": f"lower({c}) = {x}", "IsEmpty": f"{c} = ''", "IsNotEmpty": f"{c} = ''", "Contains": f"contains(lower({c}), {x})", "DoesNotContain": f"contains(lower({c}), {x})"}[r.operator]
    return f"coalesce({test}, false) {'asc' if r.operator in ('IsNot', 'IsNotEmpty', 'DoesNotContain') else 'desc'}"


def _order(prefs: Preferences) -> str:
    name = "stem" if prefs.ignore_filetype else "file_name"
    rules = [x for r in prefs.preservation_order if (x := _rule(r, f"c_{r.column}"))]
    return ", ".join(["keep desc", f"(root = {name}) desc", f"{_any('stem', prefs.tags)} asc", *rules, "id"])


def _marks(prefs: Preferences, enabled: Enabled, source: str, name: str, keys: list[str], branch: dict[str, str], reset: bool) -> str:
    """CTEs from ``source`` to ``name``: marking of groups; branch: flag to condition, tested in order."""
    known = " and ".join(f"{k} is not null" for k in keys)
    which = "case " + " ".join(f"when {c} then '{f}'" for f, c in branch.items()) + " end"
    group = f"partition by {', '.join(keys)}"
    star = ", ".join(f"case when n > 1 and known and b = '{f}' then true else {f} end as {f}" for f in branch)
    out = f""",
{name}_a as (select *, ({known}) as known, {which} as b, count(*) over ({group}) as n, row_number() over ({group} order by {_order(prefs)}) as i from {source}),
{name}_b as (select * exclude ({", ".join(branch)}, keep, known, b, n, i), {star}, case when n > 1 and known and b is not null and i > 1 then false else keep end as keep, (n > 1 and known) as grouped from {name}_a)"""
    if not reset:
        return out + f", {name} as (select * exclude (grouped) from {name}_b)"
    others = ("wave", "dual", "repl", "dur", "inv", "ftag", "tag", "cmp", "simaudio", "simname", "basic")
    return out + f""",
{name}_c as (select *, (grouped and bool_and(keep) over ({group})) as again from {name}_b),
{name} as (select * exclude (grouped, again, {", ".join(others)}), {", ".join(f"({f} and not again) as {f}" for f in others)} from {name}_c)"""


def _dupes(prefs: Preferences, enabled: Enabled, source: str = "r0", name: str = "r1") -> str:
    by_root = enabled.filename or enabled.audiosuite
    keys = ["root" if c == "filename" and by_root else f"c_{c}" for c in prefs.match_criteria]
    tagged = _any("stem", prefs.tags)
    branch = {"basic": f"root = {_trim('file_name')} or root = {_trim('stem')}" if by_root else "true"}
    if by_root:
        branch["tag"] = tagged if enabled.audiosuite else "false"
        branch["simname"] = f"not {tagged}" if enabled.filename else "false"
    return _marks(prefs, enabled, source, name, keys, branch, reset=True)


def _exact(prefs: Preferences, source: str, name: str, only: str = "") -> str:
    fp = f"case when fingerprint <> 'FAILED'{only} then fingerprint end"
    return f", {name}_k as (select *, {fp} as fk from {source})" + _marks(prefs, Enabled(), f"{name}_k", f"{name}_m", ["fk"], {"wave": "true"}, reset=False) + f", {name} as (select * exclude (fk) from {name}_m)"


def _flags(rows: DataFrame) -> DataFrame:
    return rows.select("id", "root", shown_text(F.col("flags")).alias("algorithm"))


def _rows_of(spark, d, prefs=PLAIN, enabled=Enabled()) -> DataFrame:  # noqa: B008
    return working_rows(catalog(spark, d), prefs, enabled, table(spark, d, "compare_catalog").select(F.col("filepath").alias("file_path")))


# derived columns


@query("path_parts", _rows(PLAIN, Enabled()) + " select id, parent, file_name, stem, ext from r0")
def path_parts(spark, d):
    c = catalog(spark, d).select(F.col("rowid").alias("id"), F.coalesce("filepath", F.lit("")).alias("p"))
    return paths.with_names(c, "p").select("id", paths.parent(F.col("p")).alias("parent"), "file_name", "stem", "ext")


@query("roots", _rows(PLAIN, Enabled()) + " select id, root, base as root_of_any_type from r0")
def roots(spark, d):
    c = catalog(spark, d).select(F.col("rowid").alias("id"), F.coalesce("filepath", F.lit("")).alias("p"))
    c = paths.with_names(c, "p", model.TAGS).select("id", "p", "root")
    return paths.with_names(c.withColumnRenamed("root", "r"), "p", model.TAGS, True).select("id", F.col("r").alias("root"), F.col("root").alias("root_of_any_type"))


_K, _V = _rank("duration")
_KB, _VB = _rank("bwdate")


@query("rank_values", f"select rowid as id, {_K} as duration_kind, {_V} as duration_value, {_KB} as date_kind, {_VB} as date_value from justinmetadata")
def rank_values(spark, d):
    (k, v), (kb, vb) = rank_value(F.col("duration")), rank_value(F.col("bwdate"))
    return catalog(spark, d).select(F.col("rowid").alias("id"), k.alias("duration_kind"), v.alias("duration_value"), kb.alias("date_kind"), vb.alias("date_value"))


@query("rule_seconds", f"select rowid as id, round({_seconds('duration')}, 6) as seconds from justinmetadata")
def rule_seconds(spark, d):
    return catalog(spark, d).select(F.col("rowid").alias("id"), F.round(split_seconds(F.col("duration")), 6).alias("seconds"))


# row rules

for _name, _prefs, _enabled in (
    ("rule_min_duration", PLAIN, Enabled(duration=True, min_dur=1.0)),
    ("rule_tags_in_path", replace(PLAIN, autoselects=("_ZQ_", "Reel", ".aif")), Enabled(filetags=True)),
    ("rule_invalid_path", PLAIN, Enabled(invalidpath=True)),
    ("rule_invalid_path_for_mono", PLAIN, Enabled(dual_mono=True)),
):

    def _run(spark, d, prefs=_prefs, enabled=_enabled):
        return _flags(_rows_of(spark, d, prefs, enabled))

    query(_name, _rows(_prefs, _enabled) + f" select id, root, {SHOWN} as algorithm from r0")(_run)


@query("compare_mark", _rows(PLAIN, Enabled(dbcompare=True)) + f" select id, root, {SHOWN} as algorithm from r0")
def compare_mark(spark, d):
    return _flags(dedupe.mark_compared(_rows_of(spark, d), table(spark, d, "compare_catalog")))


# duplicates

for _name, _prefs, _enabled in (
    ("dedupe_basic", PLAIN, Enabled(basic=True)),
    ("dedupe_one_key", replace(PLAIN, match_criteria=("filename",)), Enabled(basic=True)),
    ("dedupe_null_keys", replace(PLAIN, match_criteria=("description", "channels")), Enabled(basic=True)),
    ("dedupe_similar_filename", SIMILAR, Enabled(basic=True, filename=True)),
    ("dedupe_tagged", replace(SIMILAR, tags=("_ZQ_", "_TRB", *model.TAGS)), Enabled(basic=True, audiosuite=True)),
    ("dedupe_names_and_tags", replace(SIMILAR, tags=("_ZQ_", "_TRB", *model.TAGS)), NAMES),
    ("dedupe_with_type", replace(SIMILAR, ignore_filetype=False), NAMES),
    ("dedupe_after_rules", replace(SIMILAR, autoselects=("_ZQ_",)), Enabled(basic=True, filename=True, filetags=True, duration=True, min_dur=3.0)),
):

    def _run(spark, d, prefs=_prefs, enabled=_enabled):
        return _flags(dedupe.mark_duplicates(_rows_of(spark, d, prefs, enabled), prefs, enabled))

    query(_name, _rows(_prefs, _enabled) + _dupes(_prefs, _enabled) + f" select id, root, {SHOWN} as algorithm from r1")(_run)

for _op, _col, _var in (
    ("Largest", "duration", ""), ("Smallest", "duration", ""), ("Is", "filename", "x"), ("IsNot", "channels", "2"), ("IsEmpty", "description", ""),
    ("IsNotEmpty", "description", ""), ("Contains", "pathname", "VOLUMES"), ("DoesNotContain", "pathname", "volumes"),
):
    _prefs = replace(PLAIN, match_criteria=("channels",), preservation_order=(Rule(_col, _op, _var),))

    def _run(spark, d, prefs=_prefs):
        r = _rows_of(spark, d, prefs).join(catalog(spark, d).select(F.col("rowid").alias("id"), "library"), "id")
        return dedupe.best_of_groups(r, "library", dedupe.preservation_keys(prefs))

    _lib = ", best as (select r0.*, m.library, row_number() over (partition by m.library order by " + _order(_prefs).replace("id", "r0.id") + ") as i from r0 join justinmetadata m on m.rowid = r0.id)"
    query(f"preserve_{_op.lower()}", _rows(_prefs, Enabled()) + _lib + " select library, id from best where i = 1 and library is not null")(_run)


# fingerprints


@query("exact_content", _rows(PLAIN, Enabled()) + _exact(PLAIN, "r0", "r1") + f" select id, root, {SHOWN} as algorithm from r1")
def exact_content(spark, d):
    return _flags(dedupe.mark_exact_content(_rows_of(spark, d), PLAIN))


@query("pcm_groups", _rows(PLAIN, Enabled()) + _exact(PLAIN, "r0", "r1", " and starts_with(fingerprint, 'PCM:')") + f" select id, root, {SHOWN} as algorithm from r1")
def pcm_groups(spark, d):
    return _flags(dedupe.mark_exact_content(_rows_of(spark, d), PLAIN, only_hashes=True))


_WORDS = r"""
with ok as (select rowid as id, hex(from_base64(_fingerprint)) as h from justinmetadata where _fingerprint <> '' and
    regexp_full_match(_fingerprint, '(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/][AQgw]==|[A-Za-z0-9+/]{2}[AEIMQUYcgkosw048]=)?')),
pos as (select id, i, cast('0x' || substr(h, 8 * i + 7, 2) || substr(h, 8 * i + 5, 2) || substr(h, 8 * i + 3, 2) || substr(h, 8 * i + 1, 2) as bigint) as w
    from (select id, h, unnest(range(length(h) // 8)) as i from ok)),
fps as (select id, list(w order by i) as w from pos group by id)"""


def _prints(spark, d) -> DataFrame:
    return catalog(spark, d).select(F.col("rowid").alias("id"), F.col("_fingerprint").alias("fingerprint"), "duration", "channels")


def _words(spark, d) -> DataFrame:
    c = catalog(spark, d).filter(fingerprints.is_fingerprint(F.col("_fingerprint"))).select(F.col("rowid").alias("id"), "_fingerprint")
    return fingerprints.with_words(c, "_fingerprint", "w").filter(F.size("w") > 0)


@query("fingerprint_words", _WORDS + " select id, array_to_string(w, ',') as words from fps")
def fingerprint_words(spark, d):
    r = _words(spark, d)
    return r.select("id", F.array_join(F.transform("w", lambda x: x.cast("string")), ",").alias("words"))


@query(
    "fingerprint_features",
    _WORDS + """ select id, array_to_string(list_concat([xor(w[i] & 65535, w[i + 1] >> 16) & 65535 for i in range(1, len(w))],
    [(w[i] & 255) | ((w[i + 3] & 255) << 8) for i in range(1, len(w) - 2)]), ',') as features from fps""",
)
def fingerprint_features(spark, d):
    r = _words(spark, d)
    return r.select("id", F.array_join(F.transform(fingerprints.features(F.col("w")), lambda x: x.cast("string")), ",").alias("features"))


#: Every two different fingerprints (the smallest row of each) with their likeness; d: the classes of equal ones.
_ALIKE = _WORDS + """,
d as (select min(id) as id, w from fps group by w), member as (select fps.id, d.id as class from fps join d using (w)),
sim as (select x.id as a, y.id as b, list_sum(list_transform(list_zip(x.w, y.w, true), lambda p: 32 - bit_count(xor(p[1], p[2])))) / (32.0 * least(len(x.w), len(y.w))) as s
    from d x join d y on x.id < y.id),
alike as (select a, b, s from sim where s >= 0.8)"""
_PAIRS = _ALIKE + """,
pairs as (select least(p.id, q.id) as a, greatest(p.id, q.id) as b, s from alike join member p on p.class = a join member q on q.class = b
    union all select p.id, q.id, 1.0 from member p join member q on p.class = q.class and p.id < q.id)"""


@query("similar_pairs", _PAIRS + " select a, b, round(s, 6) as similarity from pairs")
def similar_pairs(spark, d):
    return match.similar_pairs(_prints(spark, d), 0.8).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("similar_links", _ALIKE + ', n as (select c, count(*) as n from (select a as c from alike union all select b from alike) group by 1) select id, class, coalesce(n, 0) as similar_classes from member left join n on n.c = class')
def similar_links(spark, d):
    """A row for each fingerprint: its class of equal ones and the number of other classes that are alike."""
    return match.similar_links(_prints(spark, d), 0.8)


_CLUSTERS = (
    "with recursive " + _ALIKE.replace("\nwith ", "", 1)
    + ", e as (select a, b from alike union select b, a from alike), r(f, g) as (select a, a from e union select r.f, e.b from r join e on e.a = r.g),"
    + " lab as (select f, min(g) as g from r group by 1), cl as (select id, coalesce(g, class) as cluster from member left join lab on f = class)"
)


@query(
    "similar_clusters",
    _CLUSTERS + ", " + _rows(PLAIN, Enabled()).replace("\nwith ", "", 1)
    + _exact(PLAIN, "r0", "r1", " and starts_with(fingerprint, 'PCM:')") + ", r2 as (select r1.*, cluster from r1 left join cl using (id))"
    + _marks(PLAIN, Enabled(), "r2", "r3", ["cluster"], {"simaudio": "true"}, reset=False) + f" select id, root, {SHOWN} as algorithm from r3",
)
def similar_clusters(spark, d):
    return _flags(match.mark_similar(dedupe.mark_exact_content(_rows_of(spark, d), PLAIN, only_hashes=True), PLAIN))


@query("subset_pairs")
def subset_pairs(spark, d):
    """Every fingerprint that occurs in one before it; at these thresholds about a fifth of all pairs."""
    return match.subset_pairs(_prints(spark, d), 80, places=False)


@query("subset_clusters")
def subset_clusters(spark, d):
    return _flags(match.mark_subsets(_rows_of(spark, d), PLAIN))


def _neighbours(spark, d) -> DataFrame:
    """Words s and l, the shorter and the longer, of each fingerprint and that of the next row number."""
    w = _words(spark, d)
    n = w.join(w.select((F.col("id") - 1).alias("id"), F.col("w").alias("v")), "id")
    swap = F.size("w") > F.size("v")
    return n.select("id", F.when(swap, F.col("v")).otherwise(F.col("w")).alias("s"), F.when(swap, F.col("w")).otherwise(F.col("v")).alias("l"))


_NEXT = _WORDS + """, nx as (select x.id, case when len(x.w) > len(y.w) then y.w else x.w end as s, case when len(x.w) > len(y.w) then x.w else y.w end as l from fps x join fps y on y.id = x.id + 1)"""
_PATTERN = "[{0}[i] & {0}[i + 1] for i in range(1, len({0}))]"


@query("feature_match", _NEXT + f", pt as (select id, {_PATTERN.format('s')} as p, {_PATTERN.format('l')} as q from nx) select id, case when len(p) > 0 then round(len(list_filter(q, lambda x: list_contains(p, x))) / len(p), 6) end as ratio from pt")
def feature_match(spark, d):
    return _neighbours(spark, d).select("id", F.round(fingerprints.feature_ratio(F.col("s"), F.col("l")), 6).alias("ratio"))


_SHIFT = "list_sum(list_transform(list_zip({0}, {1}, true), lambda p: 32 - bit_count(xor(p[1], p[2])))) / (32.0 * least(len({0}), len({1})))"


@query(
    "similarity_shifted",
    _NEXT + ", sh as (select id, s, l, unnest(range(4)) as k from nx), one as (select id, "
    + f"case when len(s[k + 1:]) > 0 then {_SHIFT.format('s[k + 1:]', 'l')} else 0.0 end as u, case when len(l[k + 1:]) > 0 then {_SHIFT.format('l[k + 1:]', 's')} else 0.0 end as v from sh)"
    + " select id, max(greatest(u, v)) as similarity from one group by id",
)
def similarity_shifted(spark, d):
    return _neighbours(spark, d).select("id", fingerprints.similarity_shifted(F.col("s"), F.col("l")).alias("similarity"))


@query("flexible_similarity")
def flexible_similarity(spark, d):
    """Longest common subsequence of features over the shorter one's features, of each fingerprint and the next."""
    return _neighbours(spark, d).select("id", F.round(fingerprints.flexible("s", "l"), 6).alias("similarity"))


@query(
    "landmark_match",
    """with q as (select file_id as query_id, hash, time_offset as tq, count(*) as nq from fingerprints where file_id is not null and hash is not null and time_offset is not null and file_id % 50 = 0 group by 1, 2, 3),
    x as (select file_id, hash, time_offset, count(*) as nx from fingerprints where file_id is not null and hash is not null and time_offset is not null group by 1, 2, 3),
    v as (select query_id, file_id, time_offset - tq as delta, sum(nq * nx) as hits from q join x using (hash) where query_id <> file_id group by 1, 2, 3)
    select query_id, file_id, delta, cast(hits as bigint) as hits from (select *, row_number() over (partition by query_id, file_id order by hits desc, delta) as i from v) where i = 1""",
)
def landmark_match(spark, d):
    """Queries: the files whose id is divisible by 50, against all rows."""
    x = table(spark, d, "fingerprints")
    return landmarks.best_alignments(x.filter(F.col("file_id") % 50 == 0), x)


_BEST = """with q as (select file_id as query_id, hash, time_offset as tq, count(*) as nq from fingerprints where file_id is not null and hash is not null and time_offset is not null and file_id % 50 = 0 group by 1, 2, 3),
    x as (select file_id, hash, time_offset, count(*) as nx from fingerprints where file_id is not null and hash is not null and time_offset is not null group by 1, 2, 3),
    v as (select query_id, file_id, time_offset - tq as delta, sum(nq * nx) as hits from q join x using (hash) where query_id <> file_id group by 1, 2, 3),
    best as (select query_id, file_id, delta, cast(hits as bigint) as hits from (select *, row_number() over (partition by query_id, file_id order by hits desc, delta) as i from v) where i = 1),
    sizes as (select file_id, count(*) as n from fingerprints where file_id is not null and hash is not null and time_offset is not null group by 1)"""


@query(
    "landmark_matches",
    _BEST + """, k as (select b.*, a.n as q, c.n as lm from best b join sizes a on a.file_id = b.query_id join sizes c on c.file_id = b.file_id)
    select 'Exact' as kind, query_id, file_id, delta, hits from k where hits >= greatest(lm, 20) // 7 and hits >= q * 2 // 5
    union all select 'Similar', query_id, file_id, delta, hits from k where hits >= q // 4 union all select 'Subset', query_id, file_id, delta, hits from k where hits >= q // 3""",
)
def landmark_matches(spark, d):
    """Files that match a query file, by the thresholds of each kind of search."""
    x = table(spark, d, "fingerprints")
    return landmarks.matches_by_kind(landmarks.best_alignments(x.filter(F.col("file_id") % 50 == 0), x, share=4))


@query("landmark_groups", "with recursive " + _BEST.replace("with ", "", 1).replace(" and file_id % 50 = 0", "", 1) + """, k as (select b.*, a.n as q from best b join sizes a on a.file_id = b.query_id), l as (select query_id as a, file_id as b from k where hits >= q // 4),
    e as (select a, b from l union select b, a from l), r(f, g) as (select a, a from e union select r.f, e.b from r join e on e.a = r.g) select f as file_id, min(g) as group_id from r group by 1""")
def landmark_groups(spark, d):
    """Files linked by similar matches, each file asked for among all others, under the smallest of each group."""
    return landmarks.groups(table(spark, d, "fingerprints"), Stage(spark, "landmarks"))


@query("index_without_files", "select hash, file_id, time_offset from fingerprints where file_id is null or file_id not in (select rowid from justinmetadata where channels = 1)")
def index_without_files(spark, d):
    gone = catalog(spark, d).filter("channels = 1").select(F.col("rowid").alias("file_id"))
    return landmarks.remove_files(table(spark, d, "fingerprints"), gone).select("hash", "file_id", "time_offset")


# analysis and sound

_CACHE = "(select file_id as rowid, case when hash is null then 'FAILED' else cast(hash as varchar) end as value, time_offset as done_at from fingerprints where file_id is not null)"


@query(
    "pending_analysis",
    f"with l as (select rowid, value from (select *, row_number() over (partition by rowid order by done_at desc nulls last, value desc) as i from {_CACHE}) where i = 1)"
    " select rowid from justinmetadata where rowid not in (select rowid from l where value <> 'FAILED')",
)
def pending_analysis(spark, d):
    """Rows that have no result, or a failed one."""
    value = F.coalesce(F.col("hash").cast("string"), F.lit("FAILED"))
    cache = table(spark, d, "fingerprints").filter("file_id is not null").select(F.col("file_id").alias("rowid"), value.alias("value"), F.col("time_offset").alias("at"))
    return incremental.pending(catalog(spark, d), cache).select("rowid")


_SOUND = "(select vec_id, case when vec_id % 3 = 0 then list_transform(range(128), lambda i: embedding[i // 2 + 1]::double) when vec_id % 3 = 1 then list_transform(embedding, lambda x: x::double) else list_transform(range(128), lambda i: embedding[i // 2 + 1]::double + (i % 2) * 0.00005) end as x, case when vec_id % 2 = 0 then 0.0001 else 0.000001 end as eps from embeddings)"


def _sound(spark, d) -> DataFrame:
    """Interleaved stereo: every third one with both channels alike, every third with channels that differ slightly."""
    e = table(spark, d, "embeddings").withColumn("e", F.transform("embedding", lambda x: x.cast("double")))
    twice = lambda f: F.flatten(F.transform("e", lambda x: F.array(x, f(x))))
    x = F.when(F.col("vec_id") % 3 == 0, twice(lambda x: x)).when(F.col("vec_id") % 3 == 1, F.col("e")).otherwise(twice(lambda x: x + 0.00005))
    path = F.concat(F.lit("/sound/"), F.col("vec_id"), F.when(F.col("vec_id") % 2 == 0, ".aif").otherwise(".wav"))
    return e.select("vec_id", x.alias("samples"), F.lit(2).alias("channels"), path.alias("path"))


@query("dual_mono", f"select vec_id, len(list_filter(range(0, len(x), 2), lambda i: abs(x[i + 1] - x[i + 2]) > eps)) = 0 as dual_mono from {_SOUND}")
def dual_mono(spark, d):
    s = _sound(spark, d)
    return s.select("vec_id", audio.channels_identical(F.col("samples"), F.col("channels"), F.col("path")).alias("dual_mono"))


@query("mixdown", f"select vec_id, round(list_sum(list_transform(range(0, len(x), 2), lambda i: abs((x[i + 1] + x[i + 2]) / 2))), 6) as loudness from {_SOUND}")
def mixdown(spark, d):
    s = _sound(spark, d).select("vec_id", audio.mixed_down(F.col("samples"), F.col("channels")).alias("m"))
    return s.select("vec_id", F.round(F.aggregate("m", F.lit(0.0), lambda a, x: a + F.abs(x)), 6).alias("loudness"))


@query("sample_statistics", "select vec_id, round(list_avg(embedding::double[]), 6) as mean, round(list_var_pop(embedding::double[]), 6) as variance, round(list_max(embedding::double[]), 6) as maximum from embeddings")
def sample_statistics(spark, d):
    s = table(spark, d, "embeddings").select("vec_id", audio.statistics(F.col("embedding")).alias("s"))
    return s.select("vec_id", *(F.round(f"s.{c}", 6).alias(c) for c in ("mean", "variance", "maximum")))


@query(
    "ixml_tags",
    r"""with l as (select doc_id, unnest(regexp_split_to_array(text, '\r\n|[\n\r]')) as line from documents),
    k as (select doc_id, regexp_extract(line, '(?s)\A([^=]*)=', 1) as k, regexp_extract(line, '(?s)\A[^=]*=(.*)\z', 1) as v from l where contains(line, '='))
    select doc_id, regexp_replace(k, '\A[ \t]+|[ \t]+\z', '', 'g') as key, regexp_replace(v, '\A[ \t]+|[ \t]+\z', '', 'g') as value from k""",
)
def ixml_tags(spark, d):
    """key=value lines of whole texts, as embedded text tags are read."""
    return table(spark, d, "documents").select("doc_id", F.inline(audio.tag_lines(F.col("text"))))


@query("version_order", "select rowid, sign(case when channels <> bitdepth % 3 then channels - bitdepth % 3 else samplerate % 7 end) as newer from justinmetadata where channels is not null and bitdepth is not null and samplerate is not null")
def version_order(spark, d):
    c = catalog(spark, d).filter("channels is not null and bitdepth is not null and samplerate is not null")
    a = F.concat_ws(".", "channels", F.col("samplerate") % 7)
    return c.select("rowid", compare_versions(a, (F.col("bitdepth") % 3).cast("string")).cast("int").alias("newer"))


# find, replace, edits


@query("find_like", "select rowid as id, filename, 'Replace' as algorithm from justinmetadata where filename ilike '%wat_mi%so%'")
def find_like(spark, d):
    r = _rows_of(spark, d, replace(PLAIN, match_criteria=("filename",)))
    return edit.find(r, F.col("c_filename"), "Wat_Mi%sO", False).select("id", F.col("c_filename").alias("filename"), shown_text(F.col("flags")).alias("algorithm"))


@query("find_glob", "select rowid as id, filename, 'Replace' as algorithm from justinmetadata where filename glob '*[WF]*S?ft*0[1-5]*'")
def find_glob(spark, d):
    r = _rows_of(spark, d, replace(PLAIN, match_criteria=("filename",)))
    return edit.find(r, F.col("c_filename"), "[WF]*S?ft*0[1-5]", True).select("id", F.col("c_filename").alias("filename"), shown_text(F.col("flags")).alias("algorithm"))


@query("replace_text", "select rowid, case when description ilike '%Courtyard%' then replace(description, 'courtyard', 'patio') else description end as description from justinmetadata")
def replace_text(spark, d):
    return edit.replace_text(catalog(spark, d), "description", "courtyard", "patio", False, mark_dirty=True).select("rowid", "description")


_HIT = "({c} is not null and contains({c}, 'Foley'))"


@query(
    "replace_path_family",
    "select rowid, " + ", ".join(f"replace({c}, 'Foley', 'Folio') as {c}" for c in ("filename", "filepath", "pathname"))
    + ", case when " + " or ".join(_HIT.format(c=c) for c in ("filename", "filepath", "pathname")) + " then 1 else _dirty end as _dirty from justinmetadata",
)
def replace_path_family(spark, d):
    out = edit.replace_text(catalog(spark, d), "filepath", "Foley", "Folio", True, mark_dirty=True)
    return out.select("rowid", "filename", "filepath", "pathname", "_dirty")


@query("replace_side_table", "select replace(pathname, 'Foley', 'Folio') as pathname from justinrdb_pathname")
def replace_side_table(spark, d):
    return edit.replace_text(table(spark, d, "justinrdb_pathname"), "pathname", "Foley", "Folio", True).select("pathname")


def _ids(spark, d) -> DataFrame:
    return table(spark, d, "fingerprints").select(F.col("file_id").alias("rowid"))


@query("delete_ids", "select rowid, filename from justinmetadata where rowid not in (select file_id from fingerprints where file_id is not null)")
def delete_ids(spark, d):
    return edit.delete_ids(catalog(spark, d).select("rowid", "filename"), _ids(spark, d))


@query("mark_mono", "select rowid, case when s then 1 else channels end as channels, case when s then 1 else _dirty end as _dirty from (select *, rowid in (select file_id from fingerprints where file_id is not null) as s from justinmetadata)")
def mark_mono(spark, d):
    return edit.mark_mono(catalog(spark, d).select("rowid", "channels", "_dirty"), _ids(spark, d))


_UPD = "(select file_id as rowid, max(cast(hash as varchar)) as v from fingerprints where file_id is not null group by 1)"


@query("upsert_cache", f"select m.rowid, case when u.rowid is not null then u.v else _dualmono end as _dualmono from justinmetadata m left join {_UPD} u using (rowid)")
def upsert_cache(spark, d):
    u = table(spark, d, "fingerprints").select(F.col("file_id").alias("rowid"), F.col("hash").cast("string").alias("value"))
    return edit.upsert(catalog(spark, d).select("rowid", "_dualmono"), u, "_dualmono")


@query("unmatched_updates", "select distinct file_id as rowid from fingerprints where file_id is not null and file_id not in (select rowid from justinmetadata)")
def unmatched_updates(spark, d):
    return edit.unmatched_updates(catalog(spark, d), _ids(spark, d).dropna().distinct())


@query("drop_column", "select * exclude (_fingerprint, _dualmono, modificationdate) from justinmetadata")
def drop_column(spark, d):
    return edit.drop_column(edit.drop_column(edit.drop_column(catalog(spark, d), "_fingerprint"), "_dualmono"), "modificationdate")


@query("column_list", "select column_name from (describe justinmetadata) where not starts_with(column_name, '_')")
def column_list(spark, d):
    return spark.createDataFrame([(c,) for c in visible_columns(catalog(spark, d))], "column_name string")


@query("records_size", _rows(PLAIN, Enabled(duration=True, min_dur=2.0)) + " select count(*) as rows, count(*) filter (not keep) as without_keep from r0")
def records_size(spark, d):
    f = F.col("flags")
    return _rows_of(spark, d, PLAIN, Enabled(duration=True, min_dur=2.0)).agg(F.count(F.lit(1)).alias("rows"), F.count_if(~model.has(f, "Keep")).alias("without_keep"))


# results

_BASE = Enabled(basic=True, filename=True, duration=True, min_dur=1.0)
_BASE_SQL = _rows(SIMILAR, _BASE) + _dupes(SIMILAR, _BASE)
_COUNT = "(wave::int + keep::int + dual::int + repl::int + dur::int + inv::int + ftag::int + tag::int + cmp::int + simaudio::int + simname::int + basic::int)"
_SELECTED = "(select file_id from fingerprints where file_id is not null)"


def _base(spark, d) -> DataFrame:
    return dedupe.mark_duplicates(_rows_of(spark, d, SIMILAR, _BASE), SIMILAR, _BASE)


def _selection(spark, d) -> DataFrame:
    return _ids(spark, d).select(F.col("rowid").alias("id")).dropna()


for _name, _where in (
    ("All", "true"), ("Keep", "keep"), ("Remove", "not keep"), ("Relevant", f"not keep or {_COUNT} > 1"), ("basic", "basic"), ("filename", "simname"),
    ("duration", "dur"),
):

    def _run(spark, d, name=_name):
        return _flags(views.filtered(_base(spark, d), name))

    query(f"filter_{_name.lower()}", _BASE_SQL + f" select id, root, {SHOWN} as algorithm from r1 where {_where}")(_run)


@query("filter_waveform", _BASE_SQL + _exact(SIMILAR, "r1", "r2") + f" select id, root, {SHOWN} as algorithm from r2 where wave or simaudio")
def filter_waveform(spark, d):
    return _flags(views.filtered(dedupe.mark_exact_content(Stage(spark, "filter").put(_base(spark, d)), SIMILAR), "waveform"))


@query("filter_relevant_of_none", _rows(PLAIN, Enabled()) + f" select id, root, {SHOWN} as algorithm from r0")
def filter_relevant_of_none(spark, d):
    return _flags(views.filtered(_rows_of(spark, d), "Relevant"))


@query("flag_order", _BASE_SQL + f" select {SHOWN} as algorithm, count(*) as n from r1 group by 1")
def flag_order(spark, d):
    """How often each set of flags occurs, its names in the order of results."""
    return _base(spark, d).select(shown_text(F.col("flags")).alias("algorithm")).groupBy("algorithm").agg(F.count(F.lit(1)).alias("n"))


@query("filter_equal", "select rowid, filename from justinmetadata where channels = 6")
def filter_equal(spark, d):
    return views.where_equal(catalog(spark, d), "channels", 6).select("rowid", "filename")


@query("removal_counts", _BASE_SQL + f" select count(*) filter (not keep) as to_remove, count(*) filter (not keep and id in {_SELECTED}) as selected_to_remove from r1")
def removal_counts(spark, d):
    return views.removal_counts(_base(spark, d), _selection(spark, d))


@query("selection_invert", _BASE_SQL + f" select id from r1 where not keep and id not in {_SELECTED}")
def selection_invert(spark, d):
    return views.inverted(views.filtered(_base(spark, d), "Remove"), _selection(spark, d))


@query("selection_toggle", _BASE_SQL + f", s as (select distinct file_id as id from fingerprints where file_id is not null), t as (select id from r1 where not keep) select id from (select * from s union all select * from t) group by id having count(*) = 1")
def selection_toggle(spark, d):
    return views.toggled(_selection(spark, d), views.filtered(_base(spark, d), "Remove"))


@query("toggle_checks", _BASE_SQL + f", t as (select * replace (case when id in {_SELECTED} then not keep else keep end as keep) from r1) select id, root, {SHOWN} as algorithm from t")
def toggle_checks(spark, d):
    return _flags(views.edited(_base(spark, d), _selection(spark, d), "toggle"))


for _how, _keep in (("check", "false"), ("uncheck", "true")):

    def _run(spark, d, how=_how):
        return _flags(views.edited(_base(spark, d), _selection(spark, d), how))

    query(f"{_how}_rows", _BASE_SQL + f", t as (select * replace (case when id in {_SELECTED} then {_keep} else keep end as keep) from r1) select id, root, {SHOWN} as algorithm from t")(_run)


@query("selection_range", _BASE_SQL + ", e as (select min(id) as a, max(id) as b from r1 where not keep), p as (select root, id from r1, e where id in (e.a, e.b)) select id from r1 where not keep and (root, id) >= (select min((root, id)) from p) and (root, id) <= (select max((root, id)) from p)")
def selection_range(spark, d):
    """All shown rows from one to another, in the order of results."""
    shown = Stage(spark, "range").put(views.filtered(_base(spark, d), "Remove").select("id", "root"))
    ends = shown.agg(F.min("id"), F.max("id")).first()
    return views.ranged(shown, *ends)


@query("selection_all", _BASE_SQL + f" select id from r1 where not keep")
def selection_all(spark, d):
    """With nothing selected all shown rows are selected."""
    return views.all_or_none(views.filtered(_base(spark, d), "Remove"), _selection(spark, d).limit(0))


@query("work_list", _BASE_SQL + f" select id, file_path, 'remove' as action from r1 where not keep and id in {_SELECTED}")
def work_list(spark, d):
    return views.work_list(_base(spark, d), _selection(spark, d))


_FULL_SQL = (
    _rows(FULL_PREFS, FULL) + _dupes(FULL_PREFS, FULL)
    + ", r2 as (select * replace (coalesce(_dualmono = '1', false) and not inv as dual) from r1)"
    + _exact(FULL_PREFS, "r2", "r3")
)


@query("search_pipeline", _FULL_SQL + f" select id, parent as path, root, file_name as filename, {SHOWN} as algorithm, channels, bitdepth, samplerate, duration, description from r3")
def search_pipeline(spark, d):
    """Every stage but the reading of audio, on the whole catalog."""
    there = table(spark, d, "compare_catalog").select(F.col("filepath").alias("file_path"))
    return views.result_rows(search(catalog(spark, d), FULL, FULL_PREFS, table(spark, d, "compare_catalog"), there))


@query("search_ordered", _BASE_SQL + f" select id, root, {SHOWN} as algorithm from r1")
def search_ordered(spark, d):
    """Results in their final order, by root and id."""
    return _flags(views.ordered(_base(spark, d)))


QUERIES |= {"p3_found": normalise_instants.p3_found, "p3_status_report": normalise_instants.p3_status_report}
