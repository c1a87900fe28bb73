"""DuckDB SQL with the meaning of the queries that SQL can express."""

from __future__ import annotations

LEVELS = 8  # of 16 children each, so for up to 16**8 leaves a tree


def hard_negatives() -> str:
    return """
with c as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * cast(x as double))) as q
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, a.label as anchor_label, c.vec_id, c.label,
         cast(coalesce(list_inner_product(a.q, c.q), 0) as bigint) as score
  from c a join c on a.vec_id % 100 = 0 and a.vec_id <> c.vec_id),
p as (
  select anchor_id, vec_id as positive_id, score as positive_score from s where label = anchor_label
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, p.positive_id,
       cast(row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id) as integer) as rank,
       s.vec_id as negative_id, p.positive_score, s.score as negative_score
from p join s on s.anchor_id = p.anchor_id and s.label <> s.anchor_label
  and 30 * p.positive_score <= 100 * s.score and 100 * s.score <= 90 * p.positive_score
qualify row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id) <= 10"""


def merkle() -> str:
    """Two towers of levels (leaves of a source, subroots); a null source or id comes first."""
    enc = lambda c: f"case when {c} is null then '-' else concat(cast(octet_length(encode(cast({c} as varchar))) as varchar), ':', cast({c} as varchar)) end"
    leaf = lambda text: "sha256(concat(" + ", ".join(enc(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + "))"
    crc = "list_reduce(list_prepend(4294967295, list_transform(string_split(cast(doc_id as varchar), ''), lambda x: cast(ascii(x) as bigint))), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)]))"
    step = "c"
    for _ in range(8):
        step = f"(case when {step} & 1 = 1 then xor({step} >> 1, 3988292384) else {step} >> 1 end)" if step == "c" else f"list_transform([{step}], lambda y: case when y & 1 = 1 then xor(y >> 1, 3988292384) else y >> 1 end)[1]"
    parts = [f"""
with crc as (select list({step} order by c) as t from (select cast(range as bigint) as c from range(256))),
d as (
  select *, {leaf("text")} as leaf, xor({crc}, 4294967295) % 5 as fold, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low
  from documents, crc),
e as (select *, case when fold = 0 then {leaf("low")} else leaf end as now from d),
r as (
  select doc_id, leaf, now, dense_rank() over (order by source nulls first) - 1 as g,
         row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos
  from e)"""]
    for tree, base in (("a", "select g, pos, leaf as h from r"), ("b", "select 0 as g, g as pos, h from aroot")):
        parts.append(f"{tree}0 as ({base})")
        for k in range(1, LEVELS + 1):
            parts.append(f"""{tree}{k} as (
  select g, pos // 16 as pos, sha256(string_agg(h, '' order by pos)) as h from (select *, count(*) over (partition by g) as n from {tree}{k - 1}) where n > 1 group by g, pos // 16)""")
        alone = " union all ".join(f"select g, any_value(h) as h from {tree}{k} group by g having count(*) = 1" for k in range(LEVELS + 1))
        parts.append(f"{tree}root as ({alone})")
    # children of one node by level, as lists
    for tree in "ab":
        for k in range(LEVELS):
            parts.append(f"{tree}run{k} as (select g, pos // 16 as up, list(h order by pos) as hs from {tree}{k} group by g, pos // 16)")
    state, joins = ("select doc_id, leaf, now as h, g, pos, '' as sib from r"), []
    for tree in "ab":
        for k in range(LEVELS):
            name = f"{tree}up{k}"
            if tree == "b" and k == 0:
                state = f"select doc_id, leaf, h, g as src, 0 as g, g as pos, sib from ({state})"
            src = "g as src" if tree == "a" else "src"
            parts.append(f"""{name} as (
  select doc_id, leaf, {"" if tree == "a" else "src, "}s.g, pos // 16 as pos,
         case when x.n > 1 then sha256(concat(array_to_string(hs[:pos % 16], ''), h, array_to_string(hs[pos % 16 + 2:], ''))) else h end as h,
         case when x.n > 1 then concat(sib, array_to_string(hs[:pos % 16], ''), array_to_string(hs[pos % 16 + 2:], '')) else sib end as sib
  from ({state}) s left join {tree}run{k} t on t.g = s.g and t.up = s.pos // 16
  left join (select g, count(*) as n from {tree}{k} group by g) x on x.g = s.g)""")
            state = f"select * from {name}"
    return ",\n".join(parts) + f"""
select doc_id, leaf, aroot.h as subroot, broot.h as root, sha256(sib) as proof_sha256, u.h as folded_root, u.h = broot.h as verified
from bup{LEVELS - 1} u join aroot on aroot.g = u.src, broot"""


LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACE = r"\x09-\x0D\x20"


def leaked_windows(window: int = 10) -> str:
    """Every window of every item looked up among the windows of the documents."""
    words = lambda c: f"regexp_extract_all({LOWER.format(c)}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    runs = lambda n: f"list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n} - 1], ' '))"
    return f"""
with d as (select doc_id, row_number() over () as r, coalesce({words('text')}, []) as w from documents),
i as (select item_id, coalesce({words('text')}, []) as w from benchmark),
g as (
  select distinct item_id, unnest(case when len(w) >= {window} then {runs(window)} else [array_to_string(w, ' ')] end) as win,
         least(len(w), {window}) as n from i where len(w) > 0),
p as (select r, n, unnest(range(1, len(w) - n + 2)) as s, w from d, (select distinct n from g)),
f as (select r, n, s, array_to_string(w[s:s + n - 1], ' ') as win from p),
h as (select f.r, f.s, f.n, g.item_id from f join g on f.n = g.n and f.win = g.win),
c as (select r, count(distinct x) as n_hit from (select r, unnest(range(s, s + n)) as x from h) group by r),
t as (select r, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as items from h group by r)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join c using (r) left join t using (r)"""


def frequent_lines(min_docs: int = 10, min_chars: int = 1) -> str:
    key = LOWER.format(r"regexp_replace(line, '^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$', '', 'g')")
    return f"""
with d as (select doc_id, row_number() over () as r, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select r, unnest(ls) as line, unnest(range(1, len(ls) + 1)) as i from d),
k as (select r, i, line, {key} as key from l),
often as (select key from k where length(key) >= {min_chars} group by key having count(distinct r) >= {min_docs}),
kept as (select r, count(*) filter (key not in (select key from often)) as n, string_agg(line, chr(10) order by i) filter (key not in (select key from often)) as text from k group by r)
select doc_id, cast(len(ls) as bigint) as n_lines, cast(len(ls) - n as bigint) as n_dropped, sha256(coalesce(kept.text, '')) as kept_sha256
from d join kept using (r)"""


def quality() -> str:
    """Base features and the fixed rules, in any order."""
    return f"""
with d as (
  select doc_id, row_number() over () as r, coalesce(text, '') as t, coalesce(regexp_extract_all(text, '[^{SPACE}]+'), []) as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]')) as ls
  from documents),
g as (select r, i, array_to_string(w[i:i + 2], ' ') as win from (select r, w, unnest(range(1, len(w) - 1)) as i from d)),
again as (select r, i from (select r, i, count(*) over (partition by r, win) as c from g) where c > 1),
rep as (select r, count(distinct x) as n from (select r, unnest([i, i + 1, i + 2]) as x from again) group by r),
f as (
  select doc_id, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
         cast(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols, cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines,
         coalesce(rep.n, 0) as n_repeat_words, len(ls) as lines, length(regexp_replace(t, '[^A-Z]+', '', 'g')) as capitals, length(regexp_replace(t, '[^!]+', '', 'g')) as calls
  from d left join rep using (r))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words or 10 * n_symbols > n_words or 10 * n_dup_lines > 3 * lines
            or word_chars < 2 * n_words or word_chars > 20 * n_words or 10 * capitals > 4 * word_chars or 10 * calls > 3 * n_words) as kept
from f"""


def repeated_windows(length: int = 35) -> str:
    return f"""
with d as (select doc_id, row_number() over () as r, coalesce(regexp_extract_all(text, '[^{SPACE}]+'), []) as w from documents),
p as (select r, unnest(range(1, len(w) - {length} + 2)) as i, w from d),
f as (select r, i, count(*) over (partition by array_to_string(w[i:i + {length} - 1], ' ')) as c from p),
gone as (select distinct r, unnest(range(i, i + {length})) as i from f where c > 1),
words as (select r, unnest(w) as x, unnest(range(1, len(w) + 1)) as i from d),
kept as (select r, count(*) as n, string_agg(x, ' ' order by i) as text from words anti join gone using (r, i) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from d left join kept using (r)"""


ORACLE = {"op4_difference_cover": repeated_windows(), "op5_wu_manber": leaked_windows(), "op8_line_bitmaps": frequent_lines(), "op9_quality_cascade": quality(),
          "op12_hilbert_zones": hard_negatives(), "op13_merkle_descent": merkle()}
