"""Registered queries of the llm operators, and the SQL of those that SQL can express; tests hold the others against brute
force."""

from __future__ import annotations

from tapewright.llm import components, formatting, mixing, near_duplicates, packing, survivors, truncation

QUERIES = {
    "p1_found": formatting.p1_found,
    "p2_found": components.p2_found,
    "p4_found": near_duplicates.p4_found,
    "p4_classes": near_duplicates.p4_classes,
    "p5_found": survivors.p5_found,
    "p6_containers": packing.p6_containers,
    "p6_report": packing.p6_report,
    "p7_documents": mixing.p7_documents,
    "p7_shares": mixing.p7_shares,
    "p8_found": truncation.p8_found,
    "p8_report": truncation.p8_report,
}

#: Words of valid fingerprints, numbered among equal ones: two multisets have as many of these pairs in common as words.
_ELEMENTS = r"""
ok as (select rowid, duration, hex(from_base64(_fingerprint)) as h from justinmetadata where _fingerprint <> '' and
    regexp_full_match(_fingerprint, '(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/][AQgw]==|[A-Za-z0-9+/]{2}[AEIMQUYcgkosw048]=)?')),
ws as (select rowid, substr(h, 8 * i + 1, 8) as w from (select rowid, h, unnest(range(length(h) // 8)) as i from ok)),
es as (select rowid, w, row_number() over (partition by rowid, w) as k from ws),
sizes as (select rowid, count(*) as n from es group by 1)"""
_CLOCK = r"^(?:(\d+):)?(\d+):([0-5]\d)(?:[.,](\d+))?$"
_COUNT = r"(?i)^(\d+)?(?:[.,](\d+))?\s*(ms|msecs?|milliseconds?|s|secs?|seconds?|m|mins?|minutes?|h|hrs?|hours?)?\.?$"
_SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200D}\x{2028}\x{2029}\x{202F}\x{205F}\x{2060}\x{3000}\x{FEFF}]+"
_SECONDS = rf"""
t0 as (select rowid, regexp_replace(duration, '^{_SPACE}|{_SPACE}$', '', 'g') as t from justinmetadata),
t1 as (select rowid, t, regexp_matches(t, '{_CLOCK}') as clock, regexp_matches(t, '{_COUNT}') and regexp_matches(t, '\d') as num,
    regexp_extract(t, '{_CLOCK}', ['h', 'm', 's', 'f']) as c, regexp_extract(t, '{_COUNT}', ['n', 'f', 'u']) as q from t0),
t2 as (select rowid, case
    when clock then case when c.h = '' or cast(c.m as bigint) < 60 then coalesce(try_cast(c.h as bigint), 0) * 3600 + cast(c.m as bigint) * 60 + cast(c.s as bigint) + cast('0.' || substr(c.f || '0', 1, 9) as decimal(24, 9)) end
    when num then (coalesce(try_cast(q.n as bigint), 0) + cast('0.' || substr(q.f || '0', 1, 9) as decimal(24, 9))) * case when lower(q.u) similar to '(ms|milli).*' then 0.001 when lower(q.u) similar to 'm.*' then 60 when lower(q.u) similar to 'h.*' then 3600 else 1 end end as s from t1),
secs as (select rowid, s from t2 where s > 0)"""

SQL: dict[str, str] = {
    "p1_found": r"""with w as (select rowid, list_sort(regexp_extract_all(nfc_normalize(lower(nfc_normalize(filepath))), '[\p{L}\p{M}\p{N}]+')) as k from justinmetadata)
    select min(rowid) as rowid, count(*) as copies from w where len(k) > 0 group by k having count(*) > 1""",
    "p2_found": """with recursive t as (select distinct file_id as f, hash as h from fingerprints where file_id is not null and hash is not null),
    e as (select x.f as a, y.f as b from t x join t y using (h) where x.f <> y.f group by 1, 2 having count(*) >= 4),
    r(f, g) as (select a, a from e union select r.f, e.b from r join e on e.a = r.g)
    select f as file_id, min(g) as group_id from r group by 1""",
    "p4_found": f"""with {_ELEMENTS}, {_SECONDS}, hits as (select x.rowid as a, y.rowid as b, count(*) as n from es x join es y on x.w = y.w and x.k = y.k and x.rowid < y.rowid group by 1, 2)
    select a as rowid_a, b as rowid_b from hits join sizes p on p.rowid = a join sizes q on q.rowid = b join secs u on u.rowid = a join secs v on v.rowid = b
    where 10 * hits.n >= 7 * (p.n + q.n - hits.n) and abs(u.s - v.s) * 10 <= greatest(u.s, v.s)""",
}
