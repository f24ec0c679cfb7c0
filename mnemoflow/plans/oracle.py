"""SQL for the registered queries, for an engine with regular expressions without look-around and back-references.

Each text reads the given tables by their names. Where a pattern refers back to what it matched (a closing tag of the opening one's name), the names
that a text holds are looked up first and the pattern is made of them.
"""

from __future__ import annotations

from mnemoflow.functions.lexical import STOP_TERMS
from mnemoflow.functions.text import CODE_WORDS, CONTENT_ELEMENTS, DEFAULT_STRIP_TAGS, VOID_ELEMENTS
from mnemoflow.operators.recall import PROMPT_HEAD, PROMPT_TAIL
from mnemoflow.plans.queries import KEEP, SHORT_UNITS

_WS = r"\s\x0b\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


def _units(x: str) -> str:
    return rf"(length({x}) + length(regexp_replace({x}, '[^\x{{10000}}-\x{{10ffff}}]', '', 'g')))"


def _prefix(x: str, n: int) -> str:
    """The first n code units; one letter beyond the basic plane counts as two."""
    chars = f"string_split({x}, '')"
    sizes = f"list_transform({chars}, lambda c: case when unicode(c) > 65535 then 2 else 1 end)"
    cut = f"array_to_string(list_transform(list_filter(list_zip({chars}, range(1, length({x}) + 1)), lambda z: list_sum({sizes}[1:z[2]]) <= {n}), lambda z: z[1]), '')"
    return f"(case when length({x}) = {_units(x)} then substr({x}, 1, {n}) else {cut} end)"


_PUNCT = "，。、“”‘’：；！？,.!?;:\"''`~"


def _normal(x: str) -> str:
    return rf"regexp_replace(regexp_replace(coalesce({x}, ''), '[{_WS}]+', '', 'g'), '[{_PUNCT}]', '', 'g')"


def _key(x: str) -> str:
    return f"(case when {_units(x)} >= 80 then {_prefix(x, 1000)} else '' end)"


_M = "m as (select * from messages where msg_id is not null qualify row_number() over (partition by msg_id order by recv_ts desc nulls last) = 1)"
_FR = "fr as (select distinct on (frag_id) * from fragments where frag_id is not null)"
_USER = "(coalesce(is_user, false) or coalesce(role, '') = 'user')"


def _turns(name: str, hidden: bool) -> str:
    seen = "" if hidden else "and not coalesce(is_system, false)"
    return f"""{name} as (select * from (select *, sum(case when {_USER} then 1 else 0 end) over (partition by conv_id order by msg_index) as turn
        from m where not coalesce(injected, false) {seen} and conv_id is not null and msg_index is not null) where turn >= 1)"""


def _fnv(x: str) -> str:
    """FNV-1a over code units."""
    units = f"flatten(list_transform(string_split({x}, ''), lambda c: case when unicode(c) > 65535 then [55296 + ((unicode(c) - 65536) >> 10), 56320 + ((unicode(c) - 65536) & 1023)] else [unicode(c)] end))"
    return f"list_reduce(list_prepend(2166136261::bigint, list_transform({units}, lambda u: u::bigint)), lambda h, u: (xor(h, u) * 16777619) & 4294967295)"


def _base36(x: str) -> str:
    return f"lower(to_base(({x})::bigint, 36))"


def _raw(turns: str, name: str) -> str:
    """conv_id, turn, raw_turn_fingerprint, marker of every turn."""
    said = f"{_trim('coalesce(mes, $$$$)')}"
    return f"""{name}_p as (select conv_id, turn, {_normal("string_agg(case when t <> '' then (case when u then '用户：' else '角色卡：' end) || t else '' end, '' order by msg_index)")} as n
        from (select conv_id, turn, msg_index, {_USER} as u, {said} as t from {turns}) group by conv_id, turn),
      {name}_k as (select conv_id, turn, {_key('n')} as k from {name}_p),
      {name} as (select conv_id, turn::int as turn, case when k = '' then '' else 'rfp1:' || {_base36(_units('k'))} || ':' || {_base36(_fnv('k'))} || {_base36(_fnv(f"({_units('k')}::varchar || ':' || k)"))} end as raw,
        case when k = '' then 'empty:' || turn::int::varchar else 'rfp1:' || {_base36(_units('k'))} || ':' || {_base36(_fnv('k'))} || {_base36(_fnv(f"({_units('k')}::varchar || ':' || k)"))} end as marker from {name}_k)"""


def _spans(turns: str) -> str:
    return f"""spans as (select s.*, n from (select conv_id, turn, max(msg_index) as last, count(*) as n_messages from {turns} group by all) s
        join (select conv_id, max(msg_index) + 1 as n from m where conv_id is not null and msg_index is not null group by conv_id) using (conv_id))"""


_OLD = f"""{_M}, {_FR}, {_turns('t', False)}, {_turns('h', True)}, {_raw('t', 'r')}, {_raw('h', 'rh')}, {_spans('t')},
    held as (select distinct f.conv_id, coalesce(nullif(f.raw_turn_fingerprint, ''), rh.raw, '') as marker from fr f left join rh on rh.conv_id = f.conv_id and rh.turn = f.turn and rh.raw <> ''),
    old as (select spans.conv_id, spans.turn, n_messages, held.marker is not null as covered from spans join r using (conv_id, turn)
        left join (select * from held where marker <> '') held on held.conv_id = spans.conv_id and held.marker = r.marker where n > {KEEP} and last < n - {KEEP})"""

_FILL = "chr(57344)"


def _wide(x: str) -> str:
    """One letter per code unit: those beyond the basic plane are followed by a filler."""
    return rf"regexp_replace({x}, '([\x{{10000}}-\x{{10ffff}}])', '\1' || {_FILL}, 'g')"


def _narrow(x: str) -> str:
    """The reverse; half of a pair becomes the replacement character."""
    return rf"replace(regexp_replace(regexp_replace({x}, '^\x{{e000}}', chr(65533)), '[\x{{10000}}-\x{{10ffff}}]$', chr(65533)), {_FILL}, '')"


def _split(source: str, most: int, name: str = "w") -> str:
    """Parts of (id, text), id of any number of columns as a struct, by a loop over what remains."""
    at = f"({most} - length(regexp_extract(reverse(substr(rest, 1, {most})), '^[^。！？.!?\\n]*')) - 1)"
    cut = f"(case when {at} > floor(0.55 * {most}) then {at} + 1 else {most} end)"
    return f"""{name}_l(id, n, part, rest) as (
        select id, 0, '', {_wide(_trim('text'))} from {source}
        union all
        select id, n + 1, case when length(rest) <= {most} then rest else {_trim(f'substr(rest, 1, {cut}::bigint)')} end,
            case when length(rest) <= {most} then '' else {_trim(f'substr(rest, {cut}::bigint + 1)')} end
        from {name}_l where rest <> ''),
    {name} as (select id, n, {_narrow('part')} as part from {name}_l where n > 0 and part <> '')"""


_PARAGRAPHS = f"""p as (select id, unnest(l) as x, generate_subscripts(l, 1) as n from (
    select doc_id as id, list_filter(list_transform(string_split_regex({_trim(r"regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\n{3,}', chr(10) || chr(10), 'g')")}, '\\n[{_WS}]*\\n'), lambda y: {_trim('y')}), lambda y: y <> '') as l from documents where text is not null))"""

_TERMS = f"""terms as (select conv_id, coalesce(list(t order by -length(t), pos) filter (where rn <= 20), []) as terms from (
    select conv_id, t, pos, row_number() over (partition by conv_id order by -length(t), pos) as rn from (
        select conv_id, t, min(pos) as pos from (
            select conv_id, t, row_number() over (partition by conv_id order by pi, size desc, i) as pos from (
                select conv_id, pi, 0 as size, 0 as i, lower(part) as t from parts where regexp_full_match(part, '[A-Za-z0-9_]{{2,}}')
                union all
                select conv_id, pi, size, i, substr(han, i, size) from (select conv_id, pi, regexp_replace(part, '[^\\p{{Han}}]', '', 'g') as han from parts where not regexp_full_match(part, '[A-Za-z0-9_]{{2,}}')),
                    unnest([4, 3, 2]) as s(size), unnest(range(1, length(han) - size + 2)) as g(i) where length(han) >= 2 and size <= length(han)
                union all
                select conv_id, pi, 1, 1, han from (select conv_id, pi, regexp_replace(part, '[^\\p{{Han}}]', '', 'g') as han from parts where not regexp_full_match(part, '[A-Za-z0-9_]{{2,}}')) where length(han) = 1))
        where t not in ({', '.join(f"'{t}'" for t in STOP_TERMS)}) group by conv_id, t)) group by conv_id)"""


def _asked_terms(source: str) -> str:
    return rf"""parts as (select conv_id, part, row_number() over (partition by conv_id order by k) as pi from (
        select conv_id, unnest(l) as part, generate_subscripts(l, 1) as k from (select conv_id, string_split(regexp_replace(coalesce(txt, ''), '[^\p{{Han}}A-Za-z0-9_]+', ' ', 'g'), ' ') as l from ({source}))) where part <> ''), {_TERMS}"""


_LATEST = f"select conv_id, arg_max(mes, msg_index) as txt, max(msg_index) as msg_index, arg_max(msg_id, msg_index) as msg_id from m where {_USER} and not coalesce(is_system, false) and not coalesce(injected, false) and conv_id is not null and msg_index is not null group by conv_id"

INT8 = "list_transform(range(1, length(hex(b)) + 1, 2), lambda i: case when ('0x' || substr(hex(b), i, 2))::int > 127 then ('0x' || substr(hex(b), i, 2))::int - 256 else ('0x' || substr(hex(b), i, 2))::int end)"
_DECODED = f"d as (select * exclude (b), case when b is null then []::int[] else {INT8} end as v from (select *, try(from_base64(regexp_replace(embedding_q, '[\\r\\n]', '', 'g'))) as b from fr))"


def _cosine(a: str, b: str) -> str:
    return f"(list_dot_product({a}::double[], {b}::double[]) / (sqrt(list_dot_product({a}::double[], {a}::double[])) * sqrt(list_dot_product({b}::double[], {b}::double[]))))"


_RECALL_KEY = f"""(case when {_units('nrm')} >= 80 then {_prefix('nrm', 1000)} else coalesce(nullif(turn, 0)::varchar, '') || ':' || coalesce(nullif(sequence, 0)::varchar, '') || ':' || nrm end)"""
_NRM = f"{_normal(_trim('''coalesce(nullif(paragraph, ''), nullif(summary, ''), nullif(source_text, ''), '')'''))} as nrm"
_ORDER = "round(score, 4) desc, coalesce(turn, 0) desc, score desc, frag_id"
_RANKED = f"""{_FR}, {_DECODED},
    q as (select frag_id as query_id, conv_id, embedding_model as model, v as qv, coalesce(paragraph, source_text) as txt from d where frag_id % 100 = 0 and len(v) > 0 and embedding_model is not null),
    parts as (select query_id as conv_id, part, row_number() over (partition by query_id order by k) as pi from (
        select query_id, unnest(l) as part, generate_subscripts(l, 1) as k from (select query_id, string_split(regexp_replace(coalesce(txt, ''), '[^\\p{{Han}}A-Za-z0-9_]+', ' ', 'g'), ' ') as l from q)) where part <> ''), {_TERMS},
    pairs as (select q.query_id, d.*, {_cosine('qv', 'v')} as raw_score from q join d on d.conv_id = q.conv_id and d.embedding_model = q.model and len(v) = len(qv)
        where enabled is distinct from false and (embedding_dims is null or embedding_dims = 0 or embedding_dims = len(qv)) and len(v) > 0),
    hit as (select p.*, coalesce(len(list_filter(terms, lambda t: contains(lower(coalesce(source_text, '') || chr(10) || coalesce(summary, '')), lower(t)))), 0) as hits
        from pairs p left join terms on terms.conv_id = p.query_id where raw_score >= 0.3),
    sc as (select *, raw_score + least(0.08, hits * 0.015) as score, {_NRM} from hit),
    keyed as (select *, {_RECALL_KEY} as f from sc),
    once as (select * from keyed qualify row_number() over (partition by query_id, f order by {_ORDER}) = 1),
    ranked as (select *, row_number() over (partition by query_id order by {_ORDER}) as rank from once)"""
_RERANKED = f"""{_RANKED}, ranked50 as (select * from ranked where rank <= 50),
    rr as (select * from (select * exclude (rank, score), rank as old, (frag_id * 7919 % 1000) / 1000.0::double as score, false as used_fallback from ranked50 where query_id % 200 <> 0) where score >= 0.35),
    rrk as (select * exclude (old), row_number() over (partition by query_id order by score desc, old) as rank from rr qualify rank <= 10),
    re as (select query_id, frag_id, conv_id, turn, sequence, paragraph, summary, source_text, raw_score, score, rank, used_fallback from rrk
        union all select query_id, frag_id, conv_id, turn, sequence, paragraph, summary, source_text, raw_score, score, rank, true from ranked50 where query_id % 200 = 0 and rank <= 10)"""
_BEST = _trim("coalesce(nullif(paragraph, ''), nullif(summary, ''), nullif(source_text, ''), '')")
_MARK = "(chr(10) || '角色卡：')"
def _merge(rows: str) -> str:
    return f"""one as (select *, {_BEST} as x, case when turn > 0 then count(*) over (partition by query_id, turn) else 1 end as k from {rows}),
    cutup as (select *, instr(x, {_MARK}) as pos from one),
    grp as (select query_id, turn, max(score) as score, min(rank) as rank, arg_max(coalesce(sequence, 0), (score, -rank)) as sequence, true as merged,
        arg_min(case when pos > 0 then {_trim("substr(x, 1, pos - 1)")} end, (coalesce(sequence, 0), rank)) filter (where pos > 0) as usr,
        string_agg(nullif(case when pos > 0 then {_trim("substr(x, pos + 5)")} else x end, ''), chr(10) || chr(10) order by coalesce(sequence, 0), rank) as rep from cutup where k > 1 group by query_id, turn),
    mg as (select query_id, turn, sequence, score, rank, merged, concat_ws(chr(10) || chr(10), nullif(usr, ''), case when rep is not null then '角色卡：' || rep end) as text from grp
        union all select query_id, turn, coalesce(sequence, 0), score, rank, false, x from cutup where k = 1)"""


_MERGED = f"{_RERANKED}, {_merge('re')}"
_PROMPTS = f"""pr as (select query_id, '{PROMPT_HEAD}' || string_agg('  <memory_fragment turn="' || coalesce(turn, 0)::varchar || '" similarity="' || printf('%.1f', floor(score::double * 1000 + 0.5) / 10) || '%">' || chr(10) || '    ' || text || chr(10) || '  </memory_fragment>', chr(10) order by rank) || '{PROMPT_TAIL}' as prompt
    from mg where text <> '' group by query_id)"""


def _code(t: str) -> str:
    """Whether a trimmed line looks like code."""
    return rf"""({t} <> '' and (regexp_full_match({t}, '</?[^{_WS}<>]{{1,30}}/?>') or regexp_matches({t}, '^(?i)</?[a-z][A-Za-z0-9_:-]*([{_WS}]|>|/>)') or regexp_full_match({t}, '[{{}}()\[\];,]+')
    or regexp_matches({t}, '^({CODE_WORDS})([^A-Za-z0-9_]|$)') or regexp_matches({t}, '^(#include|using[{_WS}]+namespace|public:|private:|protected:|def[{_WS}]+|from[{_WS}]+[^{_WS}]+[{_WS}]+import[{_WS}]+)')
    or regexp_matches({t}, '^(?i)(@click|v-if|v-for|v-model|class=|style=|id=|data-|aria-)') or regexp_matches({t}, '^[.#]?[a-zA-Z0-9_-]+[{_WS}]*\{{')
    or (regexp_matches({t}, '[{{}};]') and regexp_matches({t}, '(=>|===|!==|&&|\|\||;[{_WS}]*$|:[{_WS}]*function|(^|[^A-Za-z0-9_])(console|document|window)\.)'))
    or (regexp_matches({t}, '(?is)</?[a-z][A-Za-z0-9_:-]*.*?>') and not regexp_matches({t}, '[，。！？、]'))))"""


_ANY = r"[\s\S]"


def _stripped(source: str, tags: str) -> tuple[list[str], str]:
    """CTEs that drop the blocks of the listed tags from (id, t), and the name of the last."""
    names = [n.strip().replace("*", f"[^<>/{_WS}]*") for n in tags.split(",")]
    steps, at = [], source
    opening = lambda n: rf"<[{_WS}]*({n})(?:[{_WS}][^>]*)?>"
    for i, n in enumerate(names):
        one = rf"'<[{_WS}]*' || regexp_escape(y) || '(?:[{_WS}][^>]*)?>{_ANY}*?</[{_WS}]*' || regexp_escape(y) || '[{_WS}]*>'"
        steps.append(rf"s{i} as (select id, case when len(l) = 0 then t else regexp_replace(t, '(?i)' || array_to_string(list_transform(l, lambda y: {one}), '|'), '', 'g') end as t from (select id, t, list_distinct(list_transform(regexp_extract_all(t, '(?i){opening(n)}', 1), lambda y: lower(y))) as l from {at}))")
        at = f"s{i}"
    for i, n in enumerate(names):
        steps.append(rf"o{i} as (select id, regexp_replace(regexp_replace(t, '(?i)\A{_ANY}*?</[{_WS}]*({n})[{_WS}]*>', ''), '(?i){opening(n)}{_ANY}*\z', '') as t from {at})")
        at = f"o{i}"
    return steps, at


def _clean(source: str) -> str:
    """CTEs up to cl: id, t with the cleaned text of (id, t)."""
    steps, at = _stripped(source, DEFAULT_STRIP_TAGS)
    elements = "|".join(f"<{e}{_ANY}*?</{e}>" for e in CONTENT_ELEMENTS.split("|"))
    gone = [
        f"(?i)image###{_ANY}*?###", rf"(?i)<think(?:ing)?\b[^>]*>{_ANY}*?</think(?:ing)?>", f"(?i)<image>{_ANY}*?</image>", f"```{_ANY}*?```", f"~~~{_ANY}*?~~~", f"(?i)<!DOCTYPE{_ANY}*?>", f"(?i)<html{_ANY}*?</html>",
        f"(?i){elements}", rf"(?i)<({VOID_ELEMENTS})\b[^>]*/?[{_WS}]*>", f"<!--{_ANY}*?-->", r"`[^`\n]{1,200}`",
    ]
    for i, pattern in enumerate(gone):
        steps.append(f"g{i} as (select id, regexp_replace(t, '{pattern}', '', 'g') as t from {at})")
        at = f"g{i}"
    steps.append(rf"ln as (select id, array_to_string(list_transform(list_filter(list_zip(l, list_transform(l, lambda y: {_trim('y')})), lambda z: not {_code('z[2]')}), lambda z: z[1]), chr(10)) as t from (select id, string_split_regex(t, '\r?\n') as l from {at}))")
    text = rf"regexp_replace(regexp_replace(t, '(?i)</?[a-z][^>]*>', '', 'g'), '</?[^{_WS}<>]{{1,30}}/?>', '', 'g')"
    for entity, char in (("nbsp", "' '"), ("amp", "'&'"), ("lt", "'<'"), ("gt", "'>'"), ("quot", "'\"'"), ("#039", "chr(39)")):
        text = f"regexp_replace({text}, '(?i)&{entity};', {char}, 'g')"
    steps.append(rf"cl as (select id, {_trim(f"regexp_replace(regexp_replace({text}, '[ \t]{{2,}}', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")} as t from ln)")
    return ", ".join(steps)


_MES = "(select msg_id as id, coalesce(mes, '') as t from m)"
# blocks of the cleaned messages: id, first, last, block
_BLOCKS = f"""{_clean(_MES)},
    bp as (select {{'id': id, 'p': k}} as id, x as text from (select id, unnest(l) as x, generate_subscripts(l, 1) as k from (
        select id, list_filter(list_transform(string_split_regex({_trim(r"regexp_replace(replace(t, chr(13) || chr(10), chr(10)), '\n{3,}', chr(10) || chr(10), 'g')")}, '\\n[{_WS}]*\\n'), lambda y: {_trim('y')}), lambda y: y <> '') as l from cl))),
    {_split('bp', 1800, 'b1')}, bq as (select {{'id': id.id, 'p': id.p, 'q': n}} as id, part as text from b1), {_split('bq', 400, 'b2')},
    pc as (select id.id as id, part as x, row_number() over (partition by id.id order by id.p, id.q, n) as n from b2),
    mf(id, n, text, first) as (select id, n, x, n from pc where n = 1
        union all select pc.id, pc.n, case when {_units('mf.text')} + 2 + {_units('pc.x')} <= 400 then mf.text || chr(10) || chr(10) || pc.x else pc.x end, case when {_units('mf.text')} + 2 + {_units('pc.x')} <= 400 then mf.first else pc.n end from mf join pc on pc.id = mf.id and pc.n = mf.n + 1),
    bl as (select id, first, max(n) as last, arg_max(text, n) as block from mf group by id, first)"""


def _said(turns: str, name: str) -> str:
    """conv_id, turn, full_text, turn_fingerprint, has_content of every turn from the cleaned messages."""
    line = "case when cl.t <> '' then (case when u then '用户：' else '角色卡：' end) || cl.t end"
    return f"""{name}_t as (select conv_id, turn::int as turn, {_trim("coalesce(string_agg(x, chr(10) || chr(10) order by msg_index), '')")} as full_text, {_normal("string_agg(x, '' order by msg_index)")} as n, bool_or(x is not null) as has_content
        from (select conv_id, turn, msg_index, {line} as x from (select *, {_USER} as u from {turns}) y join cl on cl.id = y.msg_id) group by conv_id, turn),
      {name} as (select conv_id, turn, full_text, {_key('n')} as turn_fingerprint, has_content from {name}_t)"""


def _fragments(turns: str) -> str:
    """CTEs up to fg, the fragments of the turns; cl and bl are there."""
    parts = "msg_index::varchar || ':' || (case when u then 'user' else 'assistant' end) || ':' || first::varchar || '-' || last::varchar"
    short = _trim(r"regexp_replace(paragraph, '\n{3,}', chr(10) || chr(10), 'g')")
    return f"""{_said(turns, 'sd')}, {_raw(turns, 'rt')},
    fb as (select conv_id, turn::int as turn, msg_index, nullif(name, '') as name, {_USER} as u, first, last, block, {parts} as part from {turns} x join bl on bl.id = x.msg_id),
    us as (select conv_id, turn, string_agg(block, chr(10) || chr(10) order by msg_index, first) as line, string_agg(part, '+' order by msg_index, first) as ids from fb where u group by conv_id, turn),
    rp as (select distinct conv_id, turn from fb where not u),
    fc as (select fb.*, rp.turn is not null and us.turn is not null as paired, us.line, us.ids from fb left join us using (conv_id, turn) left join rp using (conv_id, turn) where not u or rp.turn is null),
    fd as (select conv_id, turn, row_number() over (partition by conv_id, turn order by msg_index, first) as sequence, msg_index as message_index, first as paragraph_index, last as paragraph_end_index,
        (case when paired then '用户 + ' else '' end) || (case when u then '用户' else coalesce(name, 'AI') end) as speaker, case when paired then 'mixed' when u then 'user' else 'assistant' end as role,
        (case when paired then '用户：' || line || chr(10) else '' end) || (case when u then '用户：' else '角色卡：' end) || block as paragraph, turn::varchar || ':' || (case when paired then ids || '+' else '' end) || part as vector_chunk_id from fc),
    fe as (select *, {short} as c, {_normal('paragraph')} as nrm from fd),
    fg as (select fe.* exclude (c, nrm), case when {_units('c')} <= 900 then c else {_prefix('c', 900)} || '...' end as summary, '第 ' || turn::varchar || ' 轮' || chr(10) || paragraph as source_text, {_key('nrm')} as content_fingerprint,
        turn_fingerprint, raw as raw_turn_fingerprint from fe join sd using (conv_id, turn) join rt using (conv_id, turn))"""


# the documents as a hundred conversations of user messages, every one a turn; full_ says that its cleaned text isn't empty
_DOCUMENTS = f"""m as (select doc_id as msg_id, doc_id % 100 as conv_id, (doc_id // 100)::int as msg_index, true as is_user, 'user' as role, text as mes from documents where doc_id is not null),
    t as (select *, row_number() over (partition by conv_id order by msg_index) as turn from m), {_clean(_MES)}, {_raw('t', 'rw')},
    mk as (select conv_id, rw.turn, raw, marker, cl.t <> '' as full_ from rw join t using (conv_id, turn) join cl on cl.id = msg_id)"""

_SETTLED = "st as (select * from (select *, max(turn) over (partition by conv_id) as nt from h) where turn <= nt - 2)"
_SETTLED_FRAGMENTS = f"{_M}, {_FR}, {_turns('h', True)}, {_SETTLED}, {_BLOCKS}, {_fragments('st')}"


def _fresh(stored: bool) -> str:
    """CTEs up to nw: the settled fragments that the index (or with stored off an empty one) doesn't hold."""
    held = f"""hk as (select conv_id, vector_chunk_id, arg_max(coalesce(raw_turn_fingerprint, ''), (coalesce(ts, timestamp '0001-01-01'), frag_id)) as raw, arg_max(coalesce(turn_fingerprint, chr(0)), (coalesce(ts, timestamp '0001-01-01'), frag_id)) as tf from fr where vector_chunk_id is not null group by conv_id, vector_chunk_id),
    hc as (select distinct conv_id, {_key('n')} as content_fingerprint from (select conv_id, {_normal('paragraph')} as n from fr)),
    f1 as (select * from fg where not exists (select 1 from hk where hk.conv_id = fg.conv_id and hk.vector_chunk_id = fg.vector_chunk_id and ((raw <> '' and raw = fg.raw_turn_fingerprint) or (raw = '' and tf = fg.turn_fingerprint)))),
    f2 as (select * from f1 where content_fingerprint = '' or not exists (select 1 from hc where hc.conv_id = f1.conv_id and hc.content_fingerprint = f1.content_fingerprint))"""
    return f"""{_SETTLED_FRAGMENTS}, {held if stored else 'f2 as (select * from fg)'},
    nw as (select * from f2 where content_fingerprint = '' union all select * from f2 where content_fingerprint <> '' qualify row_number() over (partition by conv_id, content_fingerprint order by turn, sequence) = 1)"""


# the 64-dimensional vectors of hashed letter triples, their int8 values and base64
_EMBEDDED = f"""tx as (select row_number() over () as k, * from nw), ch as (select k, list_transform(string_split(chr(2) || {_trim('source_text')} || chr(3), ''), lambda c: unicode(c)) as c from tx),
    gr as (select k, unnest(list_transform(range(1, len(c) - 1), lambda i: ((c[i] * 961 + c[i + 1] * 31 + c[i + 2])::uhugeint * 11400714819323198485::uhugeint) % 18446744073709551616::uhugeint)) as g from ch),
    su as (select k, ((g // 1099511627776::uhugeint) % 64)::int as i, sum(case when g >= 9223372036854775808::uhugeint then 1 else -1 end)::double as v from gr group by all),
    ve as (select k, list(coalesce(v, 0.0) order by i) as v from (select k, i from tx, range(64) r(i)) left join su using (k, i) group by k),
    qu as (select k, list_max(list_transform(v, lambda x: abs(x))) as m, v from ve),
    em as (select tx.*, m / 127 as scale, to_base64(from_hex(array_to_string(list_transform(v, lambda x: printf('%02x', (floor(x / m * 127 + 0.5)::int + 256) % 256)), ''))) as q from qu join tx using (k) where m > 0)"""

ORACLE: dict[str, str] = {
    "quantize_embeddings": """with e as (select vec_id, embedding::double[] as v, list_max(list_transform(embedding::double[], lambda x: abs(x))) as m from embeddings where len(embedding) > 0)
        select vec_id, len(v)::int as dims, round(m / 127, 9) as scale, array_to_string(list_transform(v, lambda x: greatest(-127, least(127, floor(x / m * 127 + 0.5)))::int), ',') as q from e where m > 0""",
    "quantization_error": f"""with e as (select vec_id, embedding::double[] as v, list_max(list_transform(embedding::double[], lambda x: abs(x))) as m from embeddings),
        q as (select vec_id, v, list_transform(v, lambda x: greatest(-127, least(127, floor(x / m * 127 + 0.5)))) as q from e where m > 0) select vec_id, round({_cosine('v', 'q')}, 6) as cosine from q""",
    "cosine_topk": f"""select query_id, rank::int as rank, vec_id, round(cosine, 6) as cosine from (select a.vec_id as query_id, b.vec_id, {_cosine('a.embedding', 'b.embedding')} as cosine,
        row_number() over (partition by a.vec_id order by {_cosine('a.embedding', 'b.embedding')} desc, b.vec_id) as rank from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0) where rank <= 10""",
    "cosine_threshold": f"select a.vec_id as query_id, b.vec_id, round({_cosine('a.embedding', 'b.embedding')}, 6) as cosine from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0 and {_cosine('a.embedding', 'b.embedding')} >= 0.3",
    "finite_embeddings": "select vec_id, len(v)::int as n, round(list_sum(v), 6) as total from (select vec_id, list_filter(embedding::double[], lambda x: isfinite(x)) as v from embeddings)",
    "decoded_vectors": f"with {_FR}, {_DECODED} select frag_id, len(v)::int as n, coalesce(list_sum(v), 0)::int as total from d",
    "code_lines": rf"with l as (select doc_id, {_trim('line')} as t from (select doc_id, unnest(string_split_regex(text, '\r?\n')) as line from documents where text is not null)) select doc_id, count(*) as lines, count(*) filter (where {_code('t')}) as code from l group by doc_id",
    "trimmed_documents": rf"select doc_id, case when {_units('c')} <= {SHORT_UNITS} then c else {_prefix('c', SHORT_UNITS)} || '...' end as short, {_units('text')}::int as units from (select doc_id, text, {_trim(rf'regexp_replace(coalesce(text, $$$$), $${chr(92)}n{{3,}}$$, chr(10) || chr(10), $$g$$)')} as c from documents)",
    "escaped_documents": "with x as (select doc_id, replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') as t from documents) select doc_id, md5(replace(t, '''', '&apos;')) as xml, md5(replace(t, '''', '&#039;')) as html from x",
    "content_fingerprints": f"select doc_id, md5({_key('n')}) as fingerprint from (select doc_id, {_normal('text')} as n from documents)",
    "distinct_fragments": f"with {_FR} select conv_id, min(frag_id) as frag_id, count(*) as copies from (select conv_id, frag_id, {_RECALL_KEY} as f from (select *, {_NRM} from fr where conv_id is not null)) group by conv_id, f",
    "conversation_turns": f"with {_M}, {_turns('t', False)} select conv_id, msg_index, msg_id, turn::int as turn from t",
    "conversation_turns_hidden": f"with {_M}, {_turns('t', True)} select conv_id, msg_index, msg_id, turn::int as turn from t",
    "settled_turns": f"with {_M}, {_turns('t', True)} select conv_id, msg_index, turn::int as turn from (select *, max(turn) over (partition by conv_id) as n from t) where turn <= n - 2",
    "auto_window": f"with {_M}, {_turns('t', True)} select conv_id, msg_index, turn::int as turn from (select *, max(turn) over (partition by conv_id) as n from t) where turn <= n - 2 and turn > n - 5",
    "latest_user": f"with {_M} select m.conv_id, m.msg_index, m.msg_id, m.mes from m join ({_LATEST}) l using (msg_id)",
    "tag_samples": f"""with {_M} select conv_id, substr(string_agg(coalesce(mes, ''), chr(10) || chr(10) order by msg_index), 1, 12000) as sample from (select * from m where is_user is distinct from true and not coalesce(injected, false) and conv_id is not null and msg_index is not null
        qualify row_number() over (partition by conv_id order by msg_index desc) <= 2) group by conv_id""",
    "split_long_400": f"with recursive {_split('(select doc_id as id, text from documents where text is not null)', 400)} select id as doc_id, n::int as n, length(part)::int as size, md5(part) as part from w",
    "split_long_1800": f"with recursive {_split('(select doc_id as id, text from documents where text is not null)', 1800)} select id as doc_id, n::int as n, length(part)::int as size, md5(part) as part from w",
    "document_paragraphs": f"with {_PARAGRAPHS} select id as doc_id, n::int as n, md5(x) as paragraph from p",
    "merge_small": f"""with recursive {_PARAGRAPHS}, f(id, n, text, first) as (select id, n, x, n from p where n = 1
        union all select p.id, p.n, case when {_units('f.text')} + 2 + {_units('p.x')} <= 400 then f.text || chr(10) || chr(10) || p.x else p.x end, case when {_units('f.text')} + 2 + {_units('p.x')} <= 400 then f.first else p.n end from f join p on p.id = f.id and p.n = f.n + 1)
        select id as doc_id, first::int as first, max(n)::int as last, md5(arg_max(text, n)) as block from f group by id, first""",
    "raw_turn_fingerprints": f"with {_M}, {_turns('t', False)}, {_raw('t', 'r')} select conv_id, turn, raw as raw_turn_fingerprint from r",
    "turn_markers": f"with {_M}, {_turns('t', True)}, {_raw('t', 'r')} select conv_id, turn, marker from r",
    "query_terms": f"with {_M}, lu as ({_LATEST}), {_asked_terms('select conv_id, txt from lu')} select lu.conv_id, len(coalesce(terms, []))::int as n, array_to_string(coalesce(terms, []), ' ') as terms from lu left join terms using (conv_id)",
    "lexical_boost": f"""with {_M}, {_FR}, lu as ({_LATEST}), {_asked_terms('select conv_id, txt from lu')},
        h as (select frag_id, coalesce(len(list_filter(terms, lambda t: contains(lower(coalesce(source_text, '') || chr(10) || coalesce(summary, '')), lower(t)))), 0) as hits from fr join lu using (conv_id) left join terms using (conv_id))
        select frag_id, hits::int as hits, round(least(0.08, hits * 0.015), 6)::double as boost from h""",
    "hybrid_rank": f"with {_RANKED} select query_id, rank::int as rank, frag_id, round(raw_score, 6) as raw_score, round(score, 6)::double as score, hits::int as hits from ranked where rank <= 10",
    "rerank_apply": f"with {_RERANKED} select query_id, rank::int as rank, frag_id, round(score, 6)::double as score, used_fallback from re",
    "merge_same_turn": f"with {_MERGED} select query_id, turn, rank::int as rank, row_number() over (partition by query_id order by coalesce(nullif(turn, 0), 9007199254740991), sequence, rank)::int as time_rank, round(score, 6)::double as score, merged, md5(text) as text from mg",
    "recall_statistics": f"with {_MERGED} select query_id, count(*) as n, string_agg(coalesce(turn, 0)::varchar, ',' order by rank) as turns, (floor(min(score)::double * 100 + 0.5) / 100)::double as least, (floor(max(score)::double * 100 + 0.5) / 100)::double as most from mg group by query_id",
    "retained_exclusion": f"""with {_M}, {_FR}, {_turns('t', False)}, {_turns('h', True)}, {_raw('t', 'r')}, {_raw('h', 'rh')}, {_spans('t')},
        kept as (select distinct conv_id, marker from spans join r using (conv_id, turn) where last >= greatest(0, n - {KEEP})),
        x as (select f.frag_id, f.conv_id, coalesce(nullif(f.raw_turn_fingerprint, ''), nullif(rh.raw, ''), nullif(f.turn_fingerprint, '')) as tok from fr f left join rh on rh.conv_id = f.conv_id and rh.turn = f.turn)
        select frag_id, x.conv_id from x left join kept on kept.conv_id = x.conv_id and kept.marker = x.tok where kept.marker is null""",
    "keep_floors": f"with {_OLD} select conv_id, msg_index, msg_id from m where not exists (select 1 from t join old on old.conv_id = t.conv_id and old.turn = t.turn and old.covered where t.msg_id = m.msg_id)",
    "compression_statistics": f"with {_OLD} select conv_id, count(*) as old_turns, count(*) filter (where covered) as covered_turns, coalesce(sum(n_messages) filter (where covered), 0)::bigint as removed from old group by conv_id",
    "retained_turns": f"with {_M}, {_turns('t', False)}, {_raw('t', 'r')}, {_spans('t')} select conv_id, r.turn, marker from spans join r using (conv_id, turn) where last >= greatest(0, n - {KEEP})",
    "migrate_fingerprints": f"with {_M}, {_FR}, {_turns('h', True)}, {_raw('h', 'rh')} select frag_id, f.conv_id, coalesce(nullif(f.raw_turn_fingerprint, ''), rh.raw, '') as raw_turn_fingerprint from fr f left join rh on rh.conv_id = f.conv_id and rh.turn = f.turn",
    "trim_future": f"with {_M}, {_FR}, {_turns('h', True)}, c as (select conv_id, max(turn) as n from h group by conv_id) select frag_id, f.conv_id, turn from fr f left join c using (conv_id) where turn is null or turn <= coalesce(n, 0)",
    "index_statistics": f"""with {_FR} select conv_id, count(*) as records, sum(coalesce({_units('embedding_q')}, 0) + 300 + 3 * (coalesce({_units('paragraph')}, 0) + coalesce({_units('summary')}, 0) + coalesce({_units('source_text')}, 0) + coalesce({_units('turn_fingerprint')}, 0)))::bigint as bytes,
        count(distinct case when turn > 0 then turn end) as covered_turns, count(*) > 5000 as large from fr where conv_id is not null group by conv_id""",
    "model_mismatch": f"with {_FR} select conv_id, count(*) filter (where embedding_model is distinct from 'bramble-embed-m') as other_model, count(*) filter (where embedding_model = 'bramble-embed-m' and embedding_dims is not null and embedding_dims <> 0 and embedding_dims <> 128) as other_dims from fr where conv_id is not null group by conv_id",
    "index_models": "select distinct embedding_model as model, regexp_matches(embedding_model, '(?i)embed|bge|gte|(^|[^A-Za-z0-9_])e5([^A-Za-z0-9_]|$)|e5-') as embeds, regexp_matches(embedding_model, '(?i)rerank') as reranks from fragments where embedding_model is not null and embedding_model <> ''",
    "arrival_windows": f"with {_M} select epoch(date_trunc('hour', recv_ts))::bigint as window_start, origin, count(*) as n, count(*) filter (where recv_ts > send_ts + interval 1 day) as n_late from m where recv_ts is not null group by all",
    "cleaned_messages": f"with {_M}, {_clean(_MES)} select id as msg_id, t as clean from cl",
    "stripped_tags": f"with {_M}, {', '.join(_stripped('(select msg_id as id, mes as t from m where mes is not null)', 'status, think')[0])} select id as msg_id, t as kept from o1 where t <> ''",
    "message_blocks": f"with recursive {_M}, {_BLOCKS} select id as msg_id, first::int as first, last::int as last, block from bl",
    "turn_texts": f"with {_M}, {_turns('t', False)}, {_clean(_MES)}, {_said('t', 'sd')} select conv_id, turn, full_text, turn_fingerprint, has_content from sd",
    "turn_fragments": f"with recursive {_M}, {_turns('h', True)}, {_BLOCKS}, {_fragments('h')} select * replace (sequence::int as sequence, paragraph_index::int as paragraph_index, paragraph_end_index::int as paragraph_end_index) from fg",
    "new_fragments": f"with recursive {_fresh(True)} select conv_id, turn, sequence::int as sequence, vector_chunk_id, role, source_text from nw",
    "ingest_records": f"with recursive {_fresh(True)}, {_EMBEDDED} select sha256(conv_id::varchar || chr(1) || vector_chunk_id || chr(1) || raw_turn_fingerprint) as id, conv_id, turn, sequence::int as sequence, 64::int as embedding_dims, round(scale, 9) as embedding_scale, md5(q) as embedding_q from em",
    "stream_ingest": f"with recursive {_fresh(False)}, {_EMBEDDED} select conv_id, turn, sequence::int as sequence, vector_chunk_id, 64::int as embedding_dims from em",
    "empty_turns": f"""with recursive {_SETTLED_FRAGMENTS} select sd.conv_id, sd.turn, case when raw = '' then 'empty:' || sd.turn::varchar else raw end as marker from sd join rt using (conv_id, turn)
        where not has_content or not exists (select 1 from fg where fg.conv_id = sd.conv_id and fg.turn = sd.turn)""",
    "recall_prompts": f"with {_MERGED}, {_PROMPTS} select query_id, md5(prompt) as prompt, length(prompt)::int as size from pr",
    "injected_prompts": f"""with {_M}, {_RANKED}, ranked10 as (select * from ranked where rank <= 10), {_merge('ranked10')}, {_PROMPTS}, lu as ({_LATEST}),
        pl as (select conv_id, msg_index as pos, prompt from (select conv_id, min(query_id) as query_id from ranked10 group by conv_id) join pr using (query_id) join lu using (conv_id))
        select m.conv_id, (case when m.msg_index >= pl.pos then m.msg_index + 1 else m.msg_index end)::int as msg_index, msg_id::varchar as msg_id, coalesce(injected, false) as injected, md5(mes) as mes from m left join pl on pl.conv_id = m.conv_id
        union all select conv_id, pos, null, true, md5(prompt) from pl""",
    "rerank_service": f"""with {_RANKED}, l as (select r.query_id, rank, list_distinct(string_split(q.txt, '')) as a, list_distinct(string_split(coalesce(nullif(r.summary, ''), r.paragraph, ''), '')) as b from ranked r join q using (query_id) where rank <= 20 and {_trim('q.txt')} <> '')
        select query_id, (rank - 1)::int as index, len(list_intersect(a, b))::double / greatest(1, len(list_distinct(list_concat(a, b)))) as relevance_score from l""",
    "document_markers": f"with {_DOCUMENTS} select conv_id, turn, marker from mk where not full_",
    "refilled_markers": f"with {_DOCUMENTS}, old as (select conv_id, coalesce(nullif(raw, ''), 'empty:' || turn::varchar) as marker from mk where turn % 3 = 0) select distinct conv_id, marker from old where not exists (select 1 from mk where mk.conv_id = old.conv_id and full_ and old.marker in (mk.marker, 'empty:' || mk.turn::varchar))",
    "covered_turns": f"""with {_DOCUMENTS}, n as (select conv_id, max(msg_index) + 1 as n from m group by conv_id)
        select conv_id, turn, 1::bigint as n_messages, exists (select 1 from mk e where not e.full_ and e.conv_id = mk.conv_id and e.marker = mk.marker) as covered from mk join t using (conv_id, turn) join n using (conv_id) where n > {KEEP // 10} and msg_index < n - {KEEP // 10}""",
}
