"""SQL for the linkage queries: an independent statement of each, in the dialect of DuckDB."""

from __future__ import annotations

from tessera.constants import ADDRESS_ABBREVIATIONS, CHANNEL_STOPWORDS, FEATURE_STOPWORDS, NAME_ABBREVIATIONS, PHONETIC, TOKEN_STOPWORDS


def _entities(name: str, table: str, key: str, country: str, n: str, a: str) -> str:
    return f"{name} as (select 'S' || (1 + {key} % 3) || '-' || {key} entity_id, (1 + {key} % 3)::int source, {key} doc_idx, {country} country, {n} business_name, {a} business_address from {table})"


DOCS = _entities("e", "documents", "doc_id", "lang", "string_split(text, chr(10))[1]", "string_split(text, chr(10))[-1]")
PARTS = _entities("e", "part", "p_partkey", "p_brand", "p_name", "p_size || ' ' || p_type || ' ' || p_brand")
PARTS_BY_TYPE = _entities("e", "part", "p_partkey", "p_type", "p_name", "p_size || ' ' || p_type || ' ' || p_brand")
PART_TRUTH = """t as (select a.entity_id s1_id, b.entity_id target_id from e a join e b using (country, business_name) where a.source = 1 and b.source > 1),
u as (select entity_id s1_id, country, business_name from e where source = 1)"""
TRUTH = """d as (select (1 + doc_id % 3) source, doc_id, lang, md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) mark from documents),
t as (select 'S1-' || a.doc_id s1_id, 'S' || b.source || '-' || b.doc_id target_id from d a join d b on a.lang = b.lang and a.mark = b.mark where a.source = 1 and b.source > 1),
u as (select entity_id s1_id, country, business_name from e where source = 1)""".replace("\\\\", "\\")


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def clean(c: str) -> str:
    return f"lower(strip_accents({c}))"


def phonetic(c: str) -> str:
    c = f"lower({c})"
    for said, meant in PHONETIC.items():
        c = f"regexp_replace({c}, '\\b{said}\\b', '{meant}', 'g')"
    return c


def key_text(c: str) -> str:
    return f"regexp_replace({phonetic(clean(c))}, '[^a-z0-9]+', ' ', 'g')"


def without(tokens: str, stop: list[str], least: int) -> str:
    return f"list_filter({tokens}, lambda w: length(w) >= {least} and not list_contains({_list(stop)}, w))"


def channel_tokens(c: str) -> str:
    return f"list_distinct({without(f"string_split({key_text(c)}, ' ')", CHANNEL_STOPWORDS, 3)})"


def index_tokens(c: str) -> str:
    c = f"regexp_replace({clean(c)}, 'https?://\\S+|www\\.\\S+', ' ', 'g')"
    c = f"regexp_replace(regexp_replace({c}, '\\.com|\\.org|\\.net', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')"
    return f"list_distinct({without(f"string_split({c}, ' ')", TOKEN_STOPWORDS, 3)})"


def compact(c: str) -> str:
    return f"regexp_replace(regexp_replace({phonetic(clean(c))}, '[^a-z0-9]', '', 'g'), '(com|org|net)$', '')"


def number_keys(c: str) -> str:
    plain = key_text(c)
    numbers = f"list_filter(regexp_extract_all({plain}, '\\b\\d{{1,6}}\\b'), lambda n: length(n) >= 2)"
    tokens = f"list_filter({without(f"string_split({plain}, ' ')", CHANNEL_STOPWORDS, 3)}, lambda w: not regexp_full_match(w, '[0-9]+'))"
    return f"case when length({numbers}) > 0 then list_distinct(list_transform({tokens}, lambda t: ({numbers})[1]::bigint::varchar || '_' || t)) else [] end"


def joined(tokens: str) -> str:
    return f"array_to_string(list_sort({tokens}), ',')"


def normal(c: str, name: bool) -> str:
    c = f"lower({c})"
    if name:
        c = f"replace({c}, '&', ' and ')"
    c = f"trim(regexp_replace(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}\\p{{M}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
    table = "map {" + ", ".join(f"'{a}': '{b}'" for a, b in (NAME_ABBREVIATIONS if name else ADDRESS_ABBREVIATIONS).items()) + "}"
    return f"array_to_string(list_transform(list_filter(string_split({c}, ' '), lambda w: w <> ''), lambda w: coalesce(({table})[w], w)), ' ')"


def feature_tokens(c: str, name: bool) -> str:
    return without(f"string_split({normal(c, name)}, ' ')", FEATURE_STOPWORDS if name else ["none of them"], 2)


def full() -> str:
    return phonetic(clean("business_name || ' ' || business_address"))


def simple(c: str) -> str:
    return f"regexp_replace(regexp_replace(lower({c}), '[^a-z0-9\\s]', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"


def hashed(*parts: object) -> str:
    return f"('0x' || substr(md5({" || '|' || ".join(str(p) for p in parts)}), 1, 15))::bigint"


_NAME = channel_tokens("business_name")
_COMPACT = f"case when length({compact('business_name')}) >= 5 then [{compact('business_name')}] else [] end"


def _v3(name: tuple, numaddr: tuple) -> dict:
    channels = [("compact", _COMPACT, "30.0", None, None), ("numaddr", number_keys("business_address"), "15.0", *numaddr), ("name", _NAME, "2.5 / ln(df + 2)", *name)]
    return {"channels": channels, "pooled": False}


def _v1(cap: int) -> dict:
    channels = [("name", index_tokens("business_name"), "2.5 / ln(df + 2)", cap, 150), ("addr", index_tokens("business_address"), "1.2 / ln(df + 2)", cap, 100)]
    return {"channels": channels, "pooled": True}


V3, V3_TIGHT, V3_BATCH = _v3((25_000, 100), (1500, 50)), _v3((20, 5), (1500, 3)), _v3((25_000, 50), (1500, 30))
V1, V1_STUDY = _v1(4000), _v1(5000)


def _postings(index: dict) -> str:
    source = "0" if index["pooled"] else "source"
    keys = " union all ".join(f"select entity_id, doc_idx, country, source real_source, {source} source, '{c}' channel, unnest({keys}) as key from e" for c, keys, *_ in index["channels"])
    weight = "case channel " + " ".join(f"when '{c}' then {w}" for c, _, w, _, _ in index["channels"]) + " end"
    cap = " and ".join(f"(channel <> '{c}' or df <= {most})" for c, _, _, most, _ in index["channels"] if most) or "true"
    cut = " and ".join(f"(channel <> '{c}' or place <= {n})" for c, _, _, _, n in index["channels"] if n) or "true"
    return f"""k as ({keys}),
c as (select *, count(*) over (partition by country, source, channel, key) df, row_number() over (partition by country, source, channel, key order by doc_idx) place from k where real_source > 1),
p as (select country, source, channel, key, entity_id, doc_idx, df, {weight} weight from c where {cap} and {cut})"""


def _found(index: dict, k: int) -> str:
    return f"""{_postings(index)},
m as (select k.entity_id s1_id, k.doc_idx s1_idx, p.source, p.entity_id target_id, p.doc_idx, round(sum(weight), 9) score from k join p using (country, channel, key) where k.real_source = 1 group by all),
f as (select *, row_number() over (partition by s1_id, source order by score desc, doc_idx) as rank from m qualify rank <= {k})"""


def postings_sql(view: str, index: dict) -> str:
    return f"with {view}, {_postings(index)} select country, source, channel, key, entity_id, doc_idx, df, round(weight, 9) weight from p"


def candidates_sql(view: str, index: dict, k: int) -> str:
    return f"with {view}, {_found(index, k)} select s1_id, source, target_id, score, rank from f"


def lists_sql(view: str, index: dict, k: int) -> str:
    return f"with {view}, {_found(index, k)}, l as (select s1_id, string_agg(target_id, ',' order by source, rank) ids from f group by s1_id) select entity_id source1_entity_id, coalesce(ids, '') candidate_entity_ids, doc_idx s1_idx from e left join l on l.s1_id = e.entity_id where source = 1"


def _pairs(index: dict, k: int) -> str:
    return f"{_found(index, k)}, n as (select s1_id, target_id from f)"


def jaccard(a: str, b: str) -> str:
    return f"case when length(list_distinct(list_concat({a}, {b}))) = 0 then 1.0 else length(list_distinct(list_intersect({a}, {b}))) / length(list_distinct(list_concat({a}, {b}))) end"


def overlap(a: str, b: str) -> str:
    return f"case when length(list_distinct({a})) = 0 then 0.0 else length(list_distinct(list_intersect({a}, {b}))) / length(list_distinct({a})) end"


def grams(s: str, n: int) -> str:
    return f"list_distinct(list_transform(range(1, length({s}) - {n - 2}), lambda i: substr({s}, i, {n})))"


def gram_jaccard(a: str, b: str, n: int) -> str:
    return f"case when {a} = '' and {b} = '' then 1.0 when length({a}) < {n} or length({b}) < {n} then 0.0 else {jaccard(grams(a, n), grams(b, n))} end"


def contains_either(a: str, b: str) -> str:
    return f"({a} <> '' and {b} <> '' and (contains({a}, {b}) or contains({b}, {a})))"


def pair_sets_sql() -> str:
    return f"""with {DOCS}, {_pairs(V3, 25)}, kk as (select entity_id, {index_tokens('business_name')} t, lower(business_name) s from e)
select n.s1_id, n.target_id, round({jaccard('a.t', 'b.t')}, 9) jaccard, round({overlap('a.t', 'b.t')}, 9) overlap, round({gram_jaccard('a.s', 'b.s', 3)}, 9) ngram3, {contains_either('a.s', 'b.s')} contained
from n join kk a on a.entity_id = n.s1_id join kk b on b.entity_id = n.target_id"""


def lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence of strings of up to 60 characters: a row of the table is a word of bits."""
    full = (1 << 60) - 1
    at = f"coalesce(list_sum(list_transform(range(0, length({a})), lambda i: case when substr({a}, (i + 1)::int, 1) = c then 1::bigint << i::int else 0::bigint end)), 0)::bigint"
    masks = f"list_transform(string_split({b}, ''), lambda c: [{at}])"
    step = f"lambda acc, m: [((acc[1] + (acc[1] & m[1])) & {full}) | (acc[1] - (acc[1] & m[1]))]"
    return f"case when {a} = '' or {b} = '' then 0 when length({a}) > 60 then error('too long') else 60 - bit_count((list_reduce({masks}, {step}, [{full}::bigint]))[1]) end"


def ratio(a: str, b: str) -> str:
    return f"case when length({a}) + length({b}) = 0 then 100.0 else 200.0 * ({lcs(a, b)}) / (length({a}) + length({b})) end"


def _token_sets(source: str, a: str, b: str, p: str = "ts") -> str:
    """CTEs that end in p(.., tsr): the token set ratio of two strings of each row of source."""
    words = lambda c: f"list_distinct(list_filter(regexp_split_to_array({c}, '\\s+'), lambda w: w <> ''))"
    rest = lambda x, y: f"array_to_string(list_sort(list_filter({x}, lambda w: not list_contains({y}, w))), ' ')"
    of = lambda c, n: f"case when {n} = 0 then 100.0 else 200.0 * ({c}) / ({n}) end"
    whole = of("sh + gap + cl", "2 * (sh + gap) + la + lb")
    return f"""{p}1 as (select *, {words(a)} x, {words(b)} y from {source}),
{p}2 as (select *, {rest('x', 'y')} ra, {rest('y', 'x')} rb, length(array_to_string(list_intersect(x, y), ' ')) sh from {p}1),
{p}3 as (select ra, rb, {lcs('ra', 'rb')} cl from (select distinct ra, rb from {p}2)),
{p}4 as (select {p}2.*, cl, length(ra) la, length(rb) lb, case when sh > 0 then 1 else 0 end gap from {p}2 join {p}3 using (ra, rb)),
{p} as (select *, case when length(x) = 0 or length(y) = 0 then 0.0 when sh > 0 and (la = 0 or lb = 0) then 100.0 when sh > 0 then greatest({whole}, {of('sh', '2 * sh + gap + la')}, {of('sh', '2 * sh + gap + lb')}) else {whole} end tsr from {p}4)"""


def _partial(source: str, p: str) -> str:
    """CTEs that end in p(a, b, best): the best ratio of the shorter string with the windows of the longer one, of distinct (a, b)."""
    cut = "substr(l, greatest(stop - length(s), 0) + 1, least(stop, length(l)) - greatest(stop - length(s), 0))"
    return f"""{p}1 as (select a, b, a s, b l from {source} where length(a) <= length(b) union select a, b, b, a from {source} where length(b) <= length(a)),
{p}2 as (select a, b, s, {cut} w from (select *, unnest(range(1, length(l) + length(s)))::int stop from {p}1 where s <> '')),
{p}3 as (select s, w, {lcs('s', 'w')} cl from (select distinct s, w from {p}2)),
{p} as (select a, b, coalesce(best, case when a = b then 100.0 else 0.0 end) best from (select distinct a, b from {source})
left join (select a, b, max(200.0 * cl / (length(s) + length(w))) best from {p}2 join {p}3 using (s, w) group by a, b) using (a, b))"""


def _sorted(c: str) -> str:
    return f"array_to_string(list_sort(list_filter(regexp_split_to_array({c}, '\\s+'), lambda w: w <> '')), ' ')"


def _edits(source: str, p: str) -> str:
    """CTEs that end in p(a, b, ratio, best, token_sort, token_set) of the distinct (a, b) of source, as shares."""
    return f"""{p}s as (select distinct a, b from {source}), {_partial(f'{p}s', f'{p}p')}, {_token_sets(f'{p}s', 'a', 'b', f'{p}t')},
{p}o as (select a, b, tsr, {_sorted('a')} oa, {_sorted('b')} ob from {p}t),
{p} as (select a, b, {ratio('a', 'b')} / 100 ratio, best / 100 best, {ratio('oa', 'ob')} / 100 token_sort, tsr / 100 token_set from {p}o join {p}p using (a, b))"""


def partial_sql() -> str:
    return f"with {PARTS_BY_TYPE}, s as (select distinct a.business_name a, b.business_name b from e a join e b using (country)), {_partial('s', 'pr')} select a, b, round(best, 6) as partial from pr"


def edit_sql() -> str:
    srt = lambda c: f"array_to_string(list_sort(string_split({c}, ' ')), ' ')"
    return f"""with {PARTS_BY_TYPE}, s as (select distinct a.business_name a, b.business_name b from e a join e b using (country)),
{_token_sets('s', 'a', 'b')}, o as (select a, b, tsr, {srt('a')} oa, {srt('b')} ob from ts)
select a, b, round({ratio('a', 'b')}, 6) ratio, round({ratio('oa', 'ob')}, 6) token_sort, round(tsr, 6) token_set from o"""


def _scored(view: str, index: dict, k: int) -> str:
    """CTEs that end in r(s1_id, s1_idx, source, target_id, rank, sim, plain, held)."""
    return f"""{view}, {_found(index, k)}, w as (select entity_id, {full()} v from e),
s as (select f.s1_id, f.s1_idx, f.source, f.target_id, f.rank, a.v a, b.v b from f join w a on a.entity_id = s1_id join w b on b.entity_id = target_id),
{_token_sets('s', 'a', 'b')}, z as (select *, regexp_replace(a, '[^a-z0-9]', '', 'g') ac, regexp_replace(b, '[^a-z0-9]', '', 'g') bc from ts),
r as (select s1_id, s1_idx, source, target_id, rank, {contains_either('ac', 'bc')} held, round(tsr, 6) plain, round(case when {contains_either('ac', 'bc')} then greatest(tsr, 85.0) else tsr end, 6) sim from z)"""


_OWNER = "qualify row_number() over (partition by target_id order by sim desc, s1_idx, s1_id) = 1"


def links_sql(owner: bool) -> str:
    return f"with {_scored(PARTS_BY_TYPE, V3_TIGHT, 3)} select s1_id, source, target_id, sim, rank from r where sim >= 74 {_OWNER if owner else ''}"


def link_counts_sql() -> str:
    """Of every record, its class and the number of records of the other side that share a key with it and reach the threshold: no caps."""
    view = PARTS_BY_TYPE.replace("e as (", "e0 as (")
    keys = " union all ".join(f"select class_id, country, nq, nt, '{c}' channel, unnest({keys}) as key from c" for c, keys, *_ in V3["channels"])
    return f"""with {view}, e1 as (select entity_id, source, doc_idx, country, coalesce(business_name, '') business_name, coalesce(business_address, '') business_address from e0),
e as (select *, first_value(entity_id) over (partition by country, business_name, business_address order by source, doc_idx, entity_id) class_id from e1),
c as (select class_id, country, business_name, business_address, count_if(source = 1) nq, count_if(source > 1) nt from e group by all), k as ({keys}),
f as (select distinct a.class_id q, b.class_id t, a.nq, b.nt from k a join k b using (country, channel, key) where a.nq > 0 and b.nt > 0), w as (select class_id, {full()} v from c),
s as (select f.*, x.v a, y.v b from f join w x on x.class_id = q join w y on y.class_id = t), {_token_sets('s', 'a', 'b')},
z as (select *, regexp_replace(a, '[^a-z0-9]', '', 'g') ac, regexp_replace(b, '[^a-z0-9]', '', 'g') bc from ts),
r as (select q, t, nq, nt, round(case when {contains_either('ac', 'bc')} then greatest(tsr, 85.0) else tsr end, 6) sim from z),
g as (select q class_id, true asked, sum(nt) n, max(sim) best from r where sim >= 74 group by 1 union all select t, false, sum(nq), max(sim) from r where sim >= 74 group by 1)
select e.entity_id, e.source, e.class_id, coalesce(n, 0)::bigint n_links, best best_sim from e left join g on g.class_id = e.class_id and g.asked = (e.source = 1)"""


def linkage_sql() -> str:
    return f"""with {_scored(PARTS, V3, 30)}, o as (select * from r where sim >= 74 {_OWNER}), l as (select s1_id, string_agg(target_id, ',' order by source, rank) ids from o group by s1_id)
select entity_id source1_entity_id, coalesce(ids, '') matched_entity_ids, doc_idx s1_idx from e left join l on l.s1_id = e.entity_id where source = 1"""


def baseline_sql(name: str) -> str:
    if name == "a":
        return f"with {PARTS}, {PART_TRUTH}, pred as (select null::varchar s1_id, null::varchar target_id where false), {SCORES} select {SUMMARY} from scores"
    if name == "b":
        plain = "trim(regexp_replace(lower(business_name), '[^a-z0-9]+', ' ', 'g'))"
        return f"""with {PARTS}, {PART_TRUTH}, {_found(V3, 30)}, w as (select entity_id, {plain} n, {full()} v from e),
pred as (select s1_id, target_id from f join w a on a.entity_id = s1_id join w b on b.entity_id = target_id where a.n <> '' and starts_with(b.v, a.n)), {SCORES} select {SUMMARY} from scores"""
    keep = "plain >= 80" if name == "c" else f"sim >= 74 {_OWNER}"
    return f"with {_scored(PARTS, V3, 30)}, {PART_TRUTH}, pred as (select s1_id, target_id from r where {keep}), {SCORES} select {SUMMARY} from scores"


def batch_sql() -> str:
    return f"""with {_scored(PARTS, V3_BATCH, 10)}, h as (select distinct s1_id from r where sim >= 74)
select count(*) processed, count(h.s1_id) matched, count(*) - count(h.s1_id) singletons from e left join h on h.s1_id = e.entity_id where source = 1"""


def resolve_sql() -> str:
    view = PARTS.replace("e as (", "e0 as (") + """, e as (select entity_id, source, doc_idx,
case when source > 1 or country in (select country from e0 where source > 1) then country else 'US' end country, business_name, business_address from e0)"""
    said = "list_filter([case when 'compact' in met then 'compact name key' end, case when 'numaddr' in met then 'number and street key' end, case when held then 'strings contain each other' end, case when sim >= 74 then 'score reaches the threshold' else 'score is below the threshold' end], lambda x: x is not null)"
    return f"""with {_scored(view, V3, 15)}, h as (select k.entity_id s1_id, p.source, list(distinct channel) met from k join p using (country, channel, key) where k.real_source = 1 group by all),
cc as (select r.*, coalesce(met, []) met, row_number() over (partition by s1_id order by sim desc, r.source, rank) - 1 place, count(*) over (partition by s1_id) n, count_if(sim >= 74) over (partition by s1_id) hits from r left join h using (s1_id, source))
select q.entity_id s1_id, q.country, coalesce(n, 0)::int candidates_count, coalesce(hits, 0)::int matches_count, coalesce(hits, 0) = 0 is_singleton, place::int place, c.source, c.target_id entity_id, t.business_name, sim, sim >= 74 is_match, case when c.s1_id is not null then array_to_string({said}, '; ') end reasons
from e q left join cc c on c.s1_id = q.entity_id left join e t on t.entity_id = c.target_id where q.source = 1"""


def written_sql() -> str:
    return f"with {PARTS}, {_found(V3, 30)} select s1_id, target_id, row_number() over (order by first, s1_idx, f.source, rank) place from f join e on e.entity_id = s1_id join (select country, min(doc_idx) first from e where source = 1 group by 1) using (country)"


def upload_sql(limit: int) -> str:
    return f"with {PARTS}, l as (select *, row_number() over (order by doc_idx) place from e) select case when place % 7 = 0 then 'Q_' || place else entity_id end entity_id, business_name, business_address, case when place % 5 = 0 then '' else country end country, place doc_idx from l where place <= {limit}"


def stored_batch_sql() -> str:
    return f"""with {PARTS_BY_TYPE}, w as (select *, {simple('business_name')} n, {simple('business_address')} m from e), x as (select *, {phonetic("n || ' ' || m")} v, regexp_replace(n, '[^a-z0-9]', '', 'g') c from w),
base as (select * from x where source > 1 qualify row_number() over (partition by country order by source, doc_idx) <= 50),
s as (select q.entity_id s1_id, b.entity_id target_id, b.source, b.doc_idx, q.v a, b.v b, q.c ac, b.c bc from x q join base b using (country) where q.source = 1), {_token_sets('s', 'a', 'b')},
r as (select s1_id, target_id, source, doc_idx, round(case when {contains_either('ac', 'bc')} then greatest(tsr, 85.0) else tsr end, 6) sim from ts),
l as (select s1_id, array_to_string(list(target_id order by source, doc_idx)[:10], ',') c, array_to_string((list(target_id order by source, doc_idx) filter (sim >= 74))[:5], ',') m from r group by 1)
select entity_id source1_entity_id, coalesce(c, '') candidate_entity_ids, coalesce(m, '') matched_entity_ids from e left join l on l.s1_id = e.entity_id where source = 1"""


def stored_sql(keep: int) -> str:
    return f"""with {PARTS_BY_TYPE}, w as (select *, {simple('business_name')} n, {simple('business_address')} m from e), x as (select *, {phonetic("n || ' ' || m")} v, regexp_replace(n, '[^a-z0-9]', '', 'g') c from w),
base as (select * from x where source > 1 qualify row_number() over (partition by country, source order by doc_idx) <= {keep}),
s as (select q.entity_id s1_id, b.entity_id target_id, q.v a, b.v b, q.c ac, b.c bc from x q join base b using (country) where q.source = 1), {_token_sets('s', 'a', 'b')}
select s1_id, target_id, round(case when {contains_either('ac', 'bc')} then greatest(tsr, 85.0) else tsr end, 6) sim from ts"""


def features_sql(names: list[str], view: str = DOCS, index: dict = V3, k: int = 25) -> str:
    num = lambda x: f"case when length(a.d) = 0 and length(b.d) = 0 then 1.0 when length(a.d) = 0 or length(b.d) = 0 then 0.0 else {x} end"
    only = lambda x, y: f"length(list_filter({x}, lambda w: not list_contains({y}, w))) + length(list_filter({y}, lambda w: not list_contains({x}, w)))"
    ratio_ = lambda x, y: f"case when greatest(length({x}), length({y})) = 0 then 1.0 else least(length({x}), length({y})) / greatest(length({x}), length({y})) end"
    have = {
        "name_word_jaccard": jaccard("a.nt", "b.nt"), **{f"name_char{k}_jaccard": gram_jaccard("a.n", "b.n", k) for k in (2, 3, 4)},
        "name_overlap_1in2": overlap("a.nt", "b.nt"), "name_overlap_2in1": overlap("b.nt", "a.nt"),
        "name_len_diff": "abs(length(a.n) - length(b.n)) / (greatest(length(a.n), length(b.n)) + 1)", "name_len_ratio": ratio_("a.n", "b.n"),
        "name_diff_tokens_count": only("a.nt", "b.nt"), "name_exact_clean_match": "a.n = b.n and a.n <> ''", "addr_word_jaccard": jaccard("a.adt", "b.adt"),
        **{f"addr_char{k}_jaccard": gram_jaccard("a.a", "b.a", k) for k in (3, 4)}, "addr_overlap_1in2": overlap("a.adt", "b.adt"), "addr_overlap_2in1": overlap("b.adt", "a.adt"),
        "addr_len_ratio": ratio_("a.a", "b.a"), "addr_diff_tokens_count": only("a.adt", "b.adt"), "addr_exact_clean_match": "a.a = b.a and a.a <> ''",
        "num_jaccard": num(jaccard("a.d", "b.d")), "num_any_match": num("list_has_any(a.d, b.d)::int"), "num_count_diff": "abs(length(a.d) - length(b.d))",
        "num_exact_equal": num(f"({only('a.d', 'b.d')} = 0)::int"), "country_match": "a.country = b.country", "name_either_empty": "a.n = '' or b.n = ''", "addr_either_empty": "a.a = '' or b.a = ''",
        **{f"{part}_{said}": f"{part[0]}e.{c}" for part in ("name", "addr") for said, c in (("fuzz_ratio", "ratio"), ("partial_ratio", "best"), ("token_sort_ratio", "token_sort"), ("token_set_ratio", "token_set"))},
        "name_addr_fuzz_product": "ne.ratio * ae.ratio",
    }
    have["combined_confidence_score"] = f"0.55 * ne.token_sort + 0.35 * ae.token_sort + 0.10 * ({have['num_any_match']})"
    edits = join = ""
    if any(n.endswith("fuzz_ratio") for n in names):
        edits = f", np as (select a.n a, b.n b from n join kk a on a.entity_id = n.s1_id join kk b on b.entity_id = n.target_id), {_edits('np', 'ne')}, ap as (select a.a a, b.a b from n join kk a on a.entity_id = n.s1_id join kk b on b.entity_id = n.target_id), {_edits('ap', 'ae')}"
        join = "join ne on ne.a = a.n and ne.b = b.n join ae on ae.a = a.a and ae.b = b.a"
    sides = f"select entity_id, country, {normal('business_name', True)} n, {normal('business_address', False)} a, list_distinct({feature_tokens('business_name', True)}) nt, list_distinct({feature_tokens('business_address', False)}) adt, list_distinct(regexp_extract_all(business_address, '\\d{{3,}}')) d from e"
    return f"with {view}, {_pairs(index, k)}, kk as ({sides}){edits} select n.s1_id, n.target_id, {', '.join(f'round(({have[n]})::double, 9) {n}' for n in names)} from n join kk a on a.entity_id = n.s1_id join kk b on b.entity_id = n.target_id {join}"


SUMMARY = """count(*) n_entities, round(avg(f05), 9) macro_f05, round(avg(p), 9) macro_precision, round(avg(r), 9) macro_recall,
round(case when count_if(n_true = 0) = 0 then 1.0 else count_if(n_true = 0 and n_pred = 0) / count_if(n_true = 0) end, 9) singleton_accuracy,
count_if(n_true = 0)::bigint singleton_total, count_if(n_true = 0 and n_pred = 0)::bigint singleton_correct,
coalesce(sum(tp), 0)::bigint tp_links, coalesce(sum(n_pred - tp), 0)::bigint fp_links, coalesce(sum(n_true - tp), 0)::bigint fn_links"""
SCORES = """counts as (select u.s1_id, coalesce(np, 0)::bigint n_pred, coalesce(nt, 0)::bigint n_true, coalesce(hit, 0)::bigint tp from u
left join (select s1_id, count(*) np from pred group by 1) using (s1_id) left join (select s1_id, count(*) nt from t group by 1) using (s1_id)
left join (select s1_id, count(*) hit from pred join t using (s1_id, target_id) group by 1) using (s1_id)),
scores as (select *, case when n_true = 0 then (n_pred = 0)::int::double when n_pred = 0 then 0.0 else tp / n_pred end p,
case when n_true = 0 then 1.0 when n_pred = 0 then 0.0 else tp / n_true end r,
case when n_true = 0 and n_pred = 0 then 1.0 when n_true = 0 or n_pred = 0 or tp = 0 then 0.0 else 5.0 * tp / (5 * tp + 4 * (n_pred - tp) + (n_true - tp)) end f05 from counts)"""
EQUAL_NAMES = f"select distinct a.entity_id s1_id, b.entity_id target_id from e a join e b on a.country = b.country and {clean('a.business_name')} = {clean('b.business_name')} where a.source = 1 and b.source > 1"
BUCKETS = """select case when f05 >= 1 then '1.0' when f05 >= 0.75 then '0.75-1.0' when f05 >= 0.5 then '0.5-0.75' when f05 >= 0.25 then '0.25-0.5' when f05 > 0 then '0.0-0.25' else '0.0' end bucket,
count(*) n, round(count(*) / sum(count(*)) over (), 9) as share from scores group by 1"""
COHORTS = f"""select cohort, {SUMMARY} from (select *, unnest(list_filter([case when n_true = 0 then 'singletons' end, case when n_true >= 3 then 'three_or_more' end, case when n_true = 1 then 'one_match' end,
case when length(list_filter(regexp_split_to_array(business_name, '\\s+'), lambda x: x <> '')) <= 2 then 'short_name' end], lambda x: x is not null)) cohort from scores join u using (s1_id)) group by cohort""".replace("\\\\", "\\")


def eval_sql(final: str, predictions: str = EQUAL_NAMES) -> str:
    return f"with {DOCS}, {TRUTH}, pred as ({predictions}), {SCORES} {final}"


_FOUND_DOCS = f"{_found(V3, 25)}, pred as (select s1_id, target_id from f)"


def blocking_sql() -> str:
    return f"with {DOCS}, {TRUTH}, {_FOUND_DOCS}, {SCORES} select round(case when sum(n_true) = 0 then 1.0 else sum(tp) / sum(n_true) end, 9) recall, round(avg(n_pred), 9) avg_candidates, sum(n_pred)::bigint total_pairs from scores"


def histogram_sql() -> str:
    between = lambda a, b: f"count_if(n_pred between {a} and {b})::bigint"
    return f"with {DOCS}, {TRUTH}, {_FOUND_DOCS}, {SCORES} select {between(0, 0)} as none, {between(1, 10)} to_10, {between(11, 30)} to_30, {between(31, 50)} to_50, max(n_pred) most from scores"


def recall_sql() -> str:
    share = lambda cond, k: f"count_if({cond} and coalesce(rank <= {k}, false)) / nullif(count_if({cond}), 0)"
    return f"""with {DOCS}, {TRUTH}, {_found(V3, 25)}, x as (select t.s1_id, t.target_id, rank from t left join f using (s1_id, target_id)),
y as (select s1_id, {', '.join(f'{share("true", k)} r{k}' for k in (1, 5, 10, 25))}, {share("starts_with(target_id, 'S2-')", 25)} s2, {share("starts_with(target_id, 'S3-')", 25)} s3, bool_and(coalesce(rank <= 25, false)) done from x group by s1_id)
select count(*) n_queries, {', '.join(f'round(avg(r{k}), 9) recall_at_{k}' for k in (1, 5, 10, 25))}, round(avg(s2), 9) s2_recall, round(avg(s3), 9) s3_recall, round(avg(done::int), 9) complete_recall from y"""


def overlap_sql() -> str:
    def tokens(c: str) -> str:
        c = f"regexp_replace(lower({c}), 'https?://\\S+|www\\.\\S+', ' ', 'g')"
        c = f"regexp_replace(regexp_replace({c}, '\\.com|\\.org|\\.net', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')"
        return without(f"string_split({c}, ' ')", TOKEN_STOPWORDS, 3)

    return f"with {DOCS}, {TRUTH}, k as (select entity_id, {tokens('business_name')} n, {tokens('business_address')} a from e) select s1_id, target_id, list_has_any(x.n, y.n) name_met, list_has_any(x.a, y.a) addr_met from t join k x on x.entity_id = s1_id join k y on y.entity_id = target_id"


def holdout_sql(final: str) -> str:
    return f"""with {DOCS}, {TRUTH}, r as (select entity_id, country, row_number() over (partition by country order by {hashed('entity_id', 42)}, entity_id) place from e where source = 1),
h as (select entity_id, country, case when place <= case country when 'en' then 60 when 'de' then 20 else 0 end then 'hidden_test' when place <= case country when 'en' then 110 when 'de' then 30 else 0 end then 'dev' else 'train_pool' end split from r) {final}"""


def negatives_sql() -> str:
    return f"""with {DOCS}, {TRUTH}, {_found(V3, 25)}, n as (select s1_id, count(*) n_true from t group by 1),
w as (select f.*, coalesce(n_true, 0) n_true from f left join n using (s1_id) where not exists (from t where t.s1_id = f.s1_id and t.target_id = f.target_id)),
x as (select s1_id, target_id from w qualify row_number() over (partition by s1_id order by rank, source, target_id) <= greatest(4 * n_true, 3))
select s1_id, target_id, 1 as label from t union all select s1_id, target_id, 0 from x"""


def sweep_sql() -> str:
    steps = ", ".join(str(round(0.20 + 0.05 * k, 2)) for k in range(14))
    return f"""with {DOCS}, {TRUTH}, {_found(V3, 25)}, g as (select unnest([{steps}])::double threshold),
x as (select s1_id, target_id, least(score / 60, 1.0) prob from f), hits as (select x.*, t.target_id is not null hit from x left join t using (s1_id, target_id)),
y as (select threshold, u.s1_id, count(prob) n_pred, count_if(hit) tp from g cross join u left join hits on hits.s1_id = u.s1_id and prob >= threshold group by all),
z as (select y.*, coalesce(nt, 0) n_true from y left join (select s1_id, count(*) nt from t group by 1) using (s1_id))
select round(threshold, 2) threshold, round(avg(case when n_true = 0 and n_pred = 0 then 1.0 when n_true = 0 or n_pred = 0 or tp = 0 then 0.0 else 5.0 * tp / (5 * tp + 4 * (n_pred - tp) + n_true - tp) end), 9) f05 from z group by threshold"""


def bootstrap_sql(repeats: int) -> str:
    draw = hashed(42, "rep", "draw")
    return eval_sql(f""", v as (select f05, row_number() over (order by {hashed('s1_id', 42)}, s1_id) - 1 as pos from scores),
g as (select rep, {draw} % (select count(*) from scores) as pos from (select range rep from range({repeats})), (select range draw from range((select count(*) from scores)))),
m as (select rep, avg(f05) m from g join v using (pos) group by rep)
select round(avg(m), 9) mean, round(stddev_pop(m), 9) std, round(quantile_cont(m, 0.025), 9) low, round(quantile_cont(m, 0.975), 9) high from m""")


def stability_sql(final: str, sample: int = 2000) -> str:
    return f"""with {DOCS}, {TRUTH}, l as (select u.s1_id, coalesce(n, 0) links from u left join (select s1_id, count(*) n from t group by 1) using (s1_id)),
r as (select *, row_number() over (partition by seed order by {hashed('s1_id', 'seed')}, s1_id) place from l, (select unnest([42, 123, 456, 789, 1024]) seed) qualify place <= {sample}),
per0 as (select seed, count(*) n, count_if(links = 0)::bigint singletons, avg(links) m, stddev_samp(links) s, string_agg(s1_id, ',' order by place) filter (place <= 5) first_ids from r group by seed),
per as (select seed, n, singletons, round(singletons / n, 9) singleton_rate, round(m, 9) mean_links, round(s, 9) std_links, first_ids from per0) {final}"""


SHIFT = f"""with {DOCS}, v as (select country as value, source = 1 a from e where source = 1 or source = 3 or country <> 'es'),
c as (select value, count_if(a)::bigint n_train, count_if(not a)::bigint n_test from v group by value)
select value, n_train, n_test, round(n_train / sum(n_train) over (), 9) p_train, round(n_test / sum(n_test) over (), 9) p_test,
round(n_test / sum(n_test) over () - n_train / sum(n_train) over (), 9) as shift, n_train = 0 and n_test > 0 unseen from c"""
