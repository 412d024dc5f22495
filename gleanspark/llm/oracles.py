"""DuckDB SQL of the queries whose results SQL can express; ``lines.sql`` has that of op10.

The others have none: op1 follows a library's merges, op4 solves for tilts, op7 and op8 need signatures, components or
subsequences, and op9's offsets of leftmost matches have no function in that engine.
"""

from __future__ import annotations

from gleanspark.llm import quality

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def repeats(window: int = 13) -> str:
    return f"""
with d as (select doc_id, {_WORDS} w from documents),
ww as (select doc_id, unnest(w) word, unnest(range(1, len(w) + 1)) i from d),
win as (select doc_id, i, array_to_string(list_slice(w, i, i + {window - 1}), ' ') s from (select doc_id, w, unnest(range(1, len(w) - {window - 2})) i from d)),
low as (select s, min(doc_id) m from win group by s),
gone as (select distinct doc_id, i + o i from win join low using (s), (select unnest(range(0, {window})) o) where m < doc_id),
kept as (select doc_id, string_agg(word, ' ' order by i) t from ww anti join gone using (doc_id, i) group by doc_id),
n as (select doc_id, count(*) n from gone group by doc_id)
select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n, 0) as bigint) n_removed, sha256(coalesce(t, '')) kept_sha256
from d left join kept using (doc_id) left join n using (doc_id)"""


_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def warc() -> str:
    five = "('0x' || substr(h, 5 * g + 1, 5))::int"
    letters = " || ".join(f"substr('{_DIGITS}', (({five} >> {s}) & 31) + 1, 1)" for s in (15, 10, 5, 0))
    return f"""
with p as (select page_id, coalesce(html, '') t from pages),
q as (select page_id, strlen(t) b, sha1(t) h, max(page_id) over (partition by t) best from p)
select page_id, cast(b as bigint) payload_bytes, array_to_string(list_transform(range(0, 8), lambda g: {letters}), '') payload_digest,
       case when page_id = best then 'response' else 'revisit' end record_type, case when page_id <> best then best end refers_to from q"""


def _holds(r: quality.Rule) -> str:
    ratio = f"{r.measure}::double / greatest({r.per}, 1)"
    bounds = [
        f"{ratio} >= {r.least}::double"
    ] * (r.least is not None) + [f"{ratio} <= {r.most}::double"] * (r.most is not None)
    return f"(n_words < {r.words} or ({' and '.join(bounds)}))"


def rules(table: tuple[quality.Rule, ...] = quality.RULES, min_words: int = 10, max_repeat_percent: int = 20) -> str:
    stop = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
    return f"""
with d as (select doc_id, coalesce(text, '') t, {_WORDS} w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) l from documents),
win as (select doc_id, i, list_slice(w, i, i + 4) s from (select doc_id, w, unnest(range(1, len(w) - 3)) i from d)),
rep as (select doc_id, i from win qualify count(*) over (partition by doc_id, s) > 1),
cov as (select doc_id, count(distinct i + o) n from rep, (select unnest(range(0, 5)) o) group by doc_id),
m as (select doc_id, cast(len(w) as bigint) n_words, cast(length(array_to_string(w, '')) as bigint) word_chars,
  cast(len(regexp_extract_all(t, '{quality.SYMBOLS}')) as bigint) n_symbols, cast(len(l) - len(list_distinct(l)) as bigint) n_dup_lines,
  cast(coalesce(n, 0) as bigint) n_repeat_words, len(l) n_lines, len(list_filter(w, lambda x: lower(x) in ({stop}))) n_stop_words,
  len(list_filter(l, lambda x: substr(ltrim(x, ' '), 1, 1) in ('•', '*', '-'))) n_bullet_lines,
  len(list_filter(l, lambda x: rtrim(x, ' ').ends_with('...') or rtrim(x, ' ').ends_with('…'))) n_ellipsis_lines
  from d left join cov using (doc_id)),
b as (select *, n_words < {min_words} or 100 * n_repeat_words > {max_repeat_percent} * n_words base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and {' and '.join(map(_holds, table))} kept from b"""


def urls(listed: list[tuple[str, str]], default: str = "allow") -> str:
    split = ((r.partition("/")[0], "".join(r.partition("/")[1:]), r, a) for a, r in listed)
    values = ", ".join(f"('{h}', '{p}', '{r}', '{a}', {k})" for k, (h, p, r, a) in enumerate(split))
    return f"""
with r(h, p, rule, verdict, k) as (values {values}),
s as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end rest from pages),
u as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from s),
f as (select page_id, max_by((rule, verdict), (len(string_split(h, '.')), length(p), k)) b from u, r
      where (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id)
select page_id, host, path, b[1] rule, coalesce(b[2], '{default}') verdict from u left join f using (page_id)"""
