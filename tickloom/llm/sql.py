"""The queries as DuckDB SQL where SQL can express them."""

from __future__ import annotations

LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

NEAR_DUPLICATES = rf"""
with recursive
w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), {LOWER}), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as g from w),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
r as (select doc_id as a, doc_id as b from documents union select r.a, e.b from r join e on r.b = e.a),
c as (select a as doc_id, min(b) as component_id from r group by 1)
select d.doc_id, coalesce(n.n, 0) as n_shingles, component_id, component_id = d.doc_id as kept
from documents d left join n using (doc_id) join c on c.doc_id = d.doc_id
"""

ORACLE_SQL = {"op1_minhash": NEAR_DUPLICATES}

QUOTES = rf"""
with recursive
m as materialized (select *, row_number() over () as rid from conversations),
l as (select conv_id, turn, rid, unnest(string_split(coalesce(text, ''), chr(10))) as line,
        generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as ord from m),
p as (select conv_id, turn, rid, ord,
        length(regexp_replace(regexp_extract(line, '(?s)^((?:[ \t]*>)+)[ \t]?(.*)$', 1), '[^>]', '', 'g')) as level,
        case when regexp_matches(line, '(?s)^((?:[ \t]*>)+)[ \t]?(.*)$')
             then regexp_extract(line, '(?s)^((?:[ \t]*>)+)[ \t]?(.*)$', 2) else line end as body from l),
h as (select rid, bool_or(level > 0) as quotes from p group by 1),
k as (select p.* from p join h using (rid)
      where not (level = 0 and quotes and regexp_matches(lower(body), '(?s)^[ \t]*on .*wrote:[ \t\r]*$'))),
n as (select conv_id, turn, rid, level, ord, trim(regexp_replace(lower(body), '[ \t\r\f\x0B]+', ' ', 'g'), ' ') as unit, body from k),
j as (select conv_id, turn, rid, level, trim(regexp_replace(lower(string_agg(body, ' ' order by ord)), '[ \t\r\f\x0B]+', ' ', 'g'), ' ') as whole
      from k group by all),
u as (select conv_id, turn, level, unit from n where unit <> ''
      union select conv_id, turn, level, s from
        (select conv_id, turn, level, unnest(string_split(regexp_replace(whole, '([.!?]) ', '\1' || chr(10), 'g'), chr(10))) as s from j) where s <> ''),
said as (select conv_id, unit, min(turn) as origin from u where level = 0 group by all),
q as (select u.*, origin from u left join said using (conv_id, unit) where level > 0),
c as (select conv_id, turn, count(*) as quoted_units, count(*) filter (origin < turn) as linked_units from q group by all),
v as (select conv_id, turn, level, origin, count(*) as votes from q where origin < turn group by all),
links as (select conv_id, turn, origin as parent from v
          qualify row_number() over (partition by conv_id, turn order by level, votes desc, origin desc) = 1),
roots as (select conv_id, turn, parent, parent as root, 1 as depth from links
          union all select r.conv_id, r.turn, r.parent, x.parent, depth + 1 from roots r join links x on x.conv_id = r.conv_id and x.turn = r.root),
placed as (select conv_id, turn, any_value(parent) as parent, min(root) as root, max(depth) as depth from roots group by all),
own as (select rid, trim(string_agg(body, chr(10) order by ord), ' ') as text from k where level = 0 group by 1)
select m.conv_id, m.turn, m.role, coalesce(own.text, '') as text, coalesce(quoted_units, 0) as quoted_units,
  coalesce(linked_units, 0) as linked_units, parent as parent_turn, coalesce(root, m.turn) as thread_turn,
  cast(coalesce(depth, 0) as bigint) as depth,
  row_number() over (partition by m.conv_id order by coalesce(root, m.turn), coalesce(depth, 0), m.turn, m.role, coalesce(own.text, '')) as position
from m left join own using (rid) left join placed on placed.conv_id = m.conv_id and placed.turn = m.turn
  left join c on c.conv_id = m.conv_id and c.turn = m.turn
"""

ORACLE_SQL["op4_quotes"] = QUOTES

# crc32 has no SQL function: bytes go through the usual table, made here from its polynomial.
_POLYNOMIAL = 0xEDB88320


def _crc_entry(value: int) -> int:
    for _ in range(8):
        value = value >> 1 ^ (_POLYNOMIAL if value & 1 else 0)
    return value


CRC_TABLE = str([_crc_entry(n) for n in range(256)])


def crc32(text: str) -> str:
    """crc32 of a text as SQL."""
    return f"""xor(list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(encode({text})), '..'),
        lambda x: cast('0x' || x as bigint))), lambda a, b: xor(a >> 8, {CRC_TABLE}[(xor(a, b) & 255) + 1])), 4294967295)"""


PREFIXES = f"""
with
t as (select conv_id as c, sha256(concat(strlen(r), ':', r, x)) as g, strlen(x) as bytes,
        row_number() over (partition by conv_id order by turn nulls first, r, sha256(concat(strlen(r), ':', r, x))) - 1 as p
      from (select *, coalesce(role, '') as r, coalesce(text, '') as x from conversations where conv_id is not null) z),
h as (select c, {crc32("cast(c as varchar)")} % 9 as h from (select distinct c from t) z),
n as (select h.c, 0 as part, p, g, bytes from h join t on t.c = h.c - h.c % 5 where p < h
      union all select h.c, 1, p, g, bytes from h join t using (c) where p >= h),
s as (select h.c, coalesce(list(g order by part, p) filter (g is not null), []) as s,
        coalesce(list(bytes order by part, p) filter (g is not null), []) as b from h left join n using (c) group by 1),
m as (select c, d, array_to_string(s[1:d], '') as k, case when d = 0 then 0 else b[d] end as bytes, len(s) = d as ends
      from (select *, unnest(range(0, len(s) + 1)) as d from s) z),
v as (select d, k, min(c) as conv_id, count(*) as n_convs, any_value(bytes) as bytes,
        sha256(coalesce(string_agg(cast(c as varchar), ',' order by c) filter (ends), '')) as ends_sha256 from m group by 1, 2),
e as (select v.*, u.conv_id as parent_conv_id, (select count(*) from v w where w.d = v.d + 1 and w.k[1:64 * v.d] = v.k) as n_children
      from v left join v u on u.d = v.d - 1 and u.k = v.k[1:64 * (v.d - 1)])
select a.conv_id, cast(a.d as bigint) as depth, any_value(a.parent_conv_id) as parent_conv_id, any_value(a.n_convs) as n_convs,
  any_value(a.n_children) as n_children, count(*) filter (b.n_children = 0) as n_leaves,
  cast(sum((b.n_convs - 1) * b.bytes) as bigint) as saved_tokens, any_value(a.ends_sha256) as ends_sha256
from e a join e b on b.d >= a.d and b.k[1:64 * a.d] = a.k group by 1, 2
"""

ORACLE_SQL["op11_prefixes"] = PREFIXES

# The bound on trusted documents lies above what the small tables have.
RULES = rf"""
with
w as materialized (select doc_id, row_number() over () as rid, coalesce(text, '') as text,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
pairs as (select rid, doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as g from w),
hashed as (select g, {crc32("g")} % 65536 as bucket from (select distinct g from pairs) z),
held as materialized (select rid, doc_id, bucket from pairs join hashed using (g)),
good as (select doc_id from labels group by 1 having min(quality) = 1),
n as (select bucket, count(*) as r, count(good.doc_id) as g from held left join good using (doc_id) group by 1),
a as (select sum(g) / sum(r) as share from n),
weights as (select bucket, cast(round(65536 * ln((g + 10.0) / (r * share + 10.0))) as bigint) as weight from n, a),
scores as (select rid, sum(weight) as llr_sum from held join weights using (bucket) group by 1),
lines as (select rid, unnest(string_split(text, chr(10))) as line from w),
dups as (select rid, count(*) - count(distinct line) as n from lines where regexp_matches(line, '[^\x20\x09-\x0D]') group by 1),
windows as (select rid, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as g,
        unnest(range(1, len(w) - 1)) as o from w),
twice as (select rid, o from (select rid, o, count(*) over (partition by rid, g) as c from windows) z where c > 1),
covered as (select rid, count(distinct o + k) as n from twice, (select unnest([0, 1, 2]) as k) z group by 1),
base as (select doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
        length(regexp_replace(array_to_string(w, ''), '[^#*$%&|<>]', '', 'g')) as n_symbols, coalesce(dups.n, 0) as n_dup_lines,
        coalesce(covered.n, 0) as n_repeat_words, cast(coalesce(llr_sum, 0) as bigint) as llr_sum, greatest(2 * len(w) - 1, 0) as n_grams
      from w left join dups using (rid) left join covered using (rid) left join scores using (rid))
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and llr_sum >= ceil(-0.15 * 65536) * n_grams as kept
from base
"""

ORACLE_SQL["op12_rules"] = RULES


def field(column: str) -> str:
    return f"coalesce(strlen(cast({column} as varchar)) || ':' || {column}, '-')"


LEAF = "sha256({})".format(" || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", "text")))
CLAIM = "sha256({})".format(" || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars + 1", "text")))

MANIFEST = f"""
with recursive
l as materialized (select doc_id, lang, {LEAF} as leaf,
        case when {crc32("cast(doc_id as varchar)")} % 7 = 0 then {CLAIM} else {LEAF} end as claim from documents),
p as materialized (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos,
        dense_rank() over (order by lang nulls first) - 1 as tree from l),
lv as (select tree, 0 as lvl, pos, leaf as h, count(*) over (partition by tree) as n from p
       union all select tree, lvl + 1, pos // 2, sha256(string_agg(h, '' order by pos)), any_value((n + 1) // 2)
       from lv where n > 1 group by tree, lvl, pos // 2),
sub as (select tree, h as subroot from lv where n = 1),
tv as (select 0 as lvl, tree as pos, subroot as h, count(*) over () as n from sub
       union all select lvl + 1, pos // 2, sha256(string_agg(h, '' order by pos)), any_value((n + 1) // 2) from tv where n > 1 group by lvl, pos // 2),
low as (select p.tree, p.pos, lv.lvl, lv.pos % 2 as side, coalesce(s.h, '') as h
        from p join lv on lv.tree = p.tree and lv.pos = p.pos >> lv.lvl and lv.n > 1
        left join lv s on s.tree = lv.tree and s.lvl = lv.lvl and s.pos = xor(lv.pos, 1)),
high as (select sub.tree, tv.lvl, tv.pos % 2 as side, coalesce(s.h, '') as h
         from sub join tv on tv.pos = sub.tree >> tv.lvl and tv.n > 1 left join tv s on s.lvl = tv.lvl and s.pos = xor(tv.pos, 1)),
lows as (select tree, pos, list(side || h order by lvl) as x from low group by 1, 2),
highs as (select tree, list(side || h order by lvl) as x from high group by 1),
f as (select doc_id, leaf, subroot, (select h from tv where n = 1) as root, claim,
        list_concat(coalesce(lows.x, []), coalesce(highs.x, [])) as steps
      from p join sub using (tree) left join lows using (tree, pos) left join highs using (tree)),
r as (select doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda x: x[2:]), '')) as proof_sha256,
        list_reduce(list_concat([claim], steps), lambda a, b: case when b[1] = '1' then sha256(b[2:] || a) else sha256(a || b[2:]) end) as folded_root
      from f)
select *, folded_root = root as verified from r
"""

ORACLE_SQL["op13_manifest"] = MANIFEST

NEAR_VECTORS = """
with recursive
v as materialized (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings),
g as materialized (select vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as norm from v
      where label is not null and len(v) > 0 and len(list_filter(v, lambda x: x is null or isnan(x) or isinf(x))) = 0),
e as materialized (select a.vec_id as a, b.vec_id as b from g a join g b on a.label = b.label and a.vec_id <> b.vec_id
      where a.norm > 0 and b.norm > 0 and len(a.v) = len(b.v) and list_dot_product(a.v, b.v) / a.norm / b.norm >= 0.93),
r as (select vec_id as a, vec_id as b from embeddings union select r.a, e.b from r join e on r.b = e.a),
c as (select a as vec_id, min(b) as component_id from r group by 1),
n as (select a as vec_id, count(*) as n_links from e group by 1)
select vec_id, coalesce(n_links, 0) as n_links, component_id, component_id = vec_id as kept
from c left join n using (vec_id)
"""

ORACLE_SQL["op2_capfilter"] = NEAR_VECTORS
