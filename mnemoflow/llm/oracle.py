"""SQL for the queries of this subpackage that it can express over whole tables."""

from mnemoflow.plans.oracle import INT8

_WS = r"\s\x0b\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"

# every vector with the others of its kind, ranked by the cosine of the whole numbers
_NEAR = rf"""d as (select distinct on (frag_id) frag_id, embedding_model, embedding_dims, try(from_base64(regexp_replace(embedding_q, '[\r\n]', '', 'g'))) as b from fragments where frag_id is not null and embedding_model is not null),
    v as (select frag_id, embedding_model, {INT8}::double[] as x from d where octet_length(b) > 0 and (embedding_dims is null or embedding_dims = octet_length(b))),
    u as (select *, list_dot_product(x, x) as xx from v where list_dot_product(x, x) > 0),
    near as (select a.frag_id, b.frag_id as other_id, list_dot_product(a.x, b.x) / sqrt(a.xx * b.xx) as cosine from u a join u b on a.embedding_model = b.embedding_model and len(a.x) = len(b.x) and a.frag_id <> b.frag_id),
    top as (select *, row_number() over (partition by frag_id order by cosine desc, other_id) as rank from near qualify rank <= 10)"""

ORACLE: dict[str, str] = {
    "p3_found": rf"""with v as (select distinct on (frag_id) frag_id, embedding_model, paragraph, source_text from fragments),
        x as (select frag_id, embedding_model, 'paragraph' as field, paragraph as t from v union all select frag_id, embedding_model, 'source_text', source_text from v),
        y as (select *, regexp_replace(t, '^[{_WS}]+|[{_WS}]+$', '', 'g') as s from x)
        select field, frag_id from y join models using (embedding_model) where length(s) + length(regexp_replace(s, '[^\x{{10000}}-\x{{10ffff}}]', '', 'g')) > max_units""",
    "p5_top10": f"with {_NEAR} select frag_id, rank::int as rank, other_id, cosine from top",
}
