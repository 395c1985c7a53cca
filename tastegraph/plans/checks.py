"""SQL that must give the same rows as each query, for an independent engine.

Written against the raw tables: each text carries the views it needs as CTEs.
Queries that cannot be stated in SQL (trained models) have no entry.
"""

import re

from tastegraph import config
from tastegraph.fixtures import VECTOR_DIM, VIEWS, with_views

# The scalar columns of the matrix, in order.
SCALARS = [
    "num_photo", "bid_num_review", "bid_avg_stars", "uid_num_fans", "uid_num_reviews",
    "uid_avg_stars", "uid_num_friends", "uid_useful", "uid_funny", "uid_cool",
    "uid_compliment_hot", "uid_compliment_more", "uid_compliment_profile", "uid_compliment_cute",
    "uid_compliment_list", "uid_compliment_note", "uid_compliment_plain", "uid_compliment_cool",
    "uid_compliment_funny", "uid_compliment_writer", "uid_compliment_photos", "uid_years_on_site",
]

_compliments = [f"compliment_{c}" for c in config.COMPLIMENTS]


def _sums(vector: str, name: str) -> str:
    return f"""cast(len({vector}) as bigint) as {name}_size,
       round(list_sum(list_transform({vector}, lambda x: x::double)), 5) as {name}_sum,
       round(list_sum(list_transform({vector}, lambda x, i: x::double * i)), 4) as {name}_weighted"""


def _user_features(pairs: str) -> str:
    values = ", ".join(
        [
            "coalesce(u.fans, 0) as uid_num_fans",
            "coalesce(u.review_count, 0) as uid_num_reviews",
            "coalesce(u.average_stars, 3.0) as uid_avg_stars",
            "coalesce(v.variance, 0.0) as uid_var_stars",
            "coalesce(len(string_split(u.friends, ',')), 1) as uid_num_friends",
            *[f"coalesce(u.{c}, 0) as uid_{c}" for c in config.INTERACTIONS + _compliments],
            "coalesce(2022 - cast(left(u.yelping_since, 4) as int), 4) as uid_years_on_site",
        ]
    )
    return f"""
select k.user_id, {values}
from (select distinct user_id from {pairs}) k
left join users u on u.user_id = k.user_id
left join (select user_id, var_pop(stars) as variance from reviews group by 1) v
  on v.user_id = k.user_id"""


def _item_features(pairs: str) -> str:
    return f"""
select k.business_id,
       coalesce(p.n, 0) as num_photo,
       coalesce(b.review_count, 0) as bid_num_review,
       coalesce(b.stars, 3.0) as bid_avg_stars,
       coalesce(v.variance, 0.0) as bid_var_stars,
       coalesce(b.city, 'NULL') as city,
       coalesce(b.is_open, 1) as is_open
from (select distinct business_id from {pairs}) k
left join business b on b.business_id = k.business_id
left join (select business_id, count(*) as n from photo
           where label in ('inside', 'outside', 'food', 'drink') group by 1) p
  on p.business_id = k.business_id
left join (select business_id, var_pop(stars) as variance from reviews group by 1) v
  on v.business_id = k.business_id"""


def _enriched(pairs: str, items: str, people: str) -> str:
    return f"""
select r.*, i.* exclude (business_id), u.* exclude (user_id)
from {pairs} r
join {items} i on i.business_id = r.business_id
join {people} u on u.user_id = r.user_id"""


_PAIR_VECTOR = """
select p.user_id, p.business_id, p.stars, coalesce(v.embedding, list_resize([]::float[], {dim}, 0)) as {name}
from pairs p left join vectors v on v.id = {key}"""

def _neighbours(asked: str) -> str:
    """Slot by slot: the item's profile and the user's taste, without the pair's own rating."""
    return f"""
select user_id, business_id,
       case when a > 1e-9 and b > 1e-9 and abs(d / a / b) > 1e-9
            then least(5.0, greatest(1.0, mean + spread * (d / a / b))) else -1.0 end as score
from (
  select user_id, business_id, any_value(mean) as mean, any_value(spread) as spread,
         sqrt(sum(x * x)) as a, sqrt(sum(y * y)) as b, sum(x * y) as d
  from (
    select q.user_id, q.business_id, u.mean, u.spread,
           coalesce(p.value, 0.0)
             - case when c.slot = k.slot then c.sign * c.off else 0.0 end as x,
           coalesce(t.value, 0.0)
             - case when l.len > 1e-9 then coalesce(c.off, 0.0) / l.len else 0.0 end
               * coalesce(p.value, 0.0) as y
    from (select distinct user_id, business_id from {asked}) q
    cross join (select unnest(range(64)) as slot) k
    left join user_spread u on u.user_id = q.user_id
    left join centred c on c.user_id = q.user_id and c.business_id = q.business_id
    left join profile_lengths l on l.business_id = q.business_id
    left join profiles p on p.business_id = q.business_id and p.slot = k.slot
    left join tastes t on t.user_id = q.user_id and t.slot = k.slot) s
  group by user_id, business_id) z"""


# Shared steps, in dependency order, on top of the input views.
STEPS = {
    "in_scope": """
select user_id, business_id from ratings union all select user_id, business_id from pairs""",
    "connections": """
select concat(business_id, '_bid') as business, md5(label) as node from label_rows
union all
select distinct concat(business_id, '_bid'), concat(business_id, '_bid') from label_rows""",
    "rating_pairs": """
select distinct concat(user_id, '_uid') as src, concat(business_id, '_bid') as dst from in_scope""",
    "category_pairs": """
select distinct least(b, n) as src, greatest(b, n) as dst
from (select concat(business_id, '_bid') as b, md5(label) as n from label_rows
      where label <> '' and business_id in (select business_id from in_scope)) z""",
    "friend_pairs": """
select distinct least(a, b) as src, greatest(a, b) as dst
from (select concat(user_id, '_uid') as a, concat(trim(f), '_uid') as b
      from (select user_id, unnest(string_split(friends, ',')) as f from users
            where user_id in (select user_id from in_scope)) y
      where trim(f) in (select user_id from in_scope)) z""",
    "all_edges": """
select * from rating_pairs union select * from category_pairs union select * from friend_pairs""",
    "item_train": _item_features("ratings"),
    "item_eval": _item_features("pairs"),
    "user_train": _user_features("ratings"),
    "user_eval": _user_features("pairs"),
    "train_enriched": _enriched("ratings", "item_train", "user_train"),
    "eval_enriched": _enriched("pairs", "item_eval", "user_eval"),
    "user_vectors": _PAIR_VECTOR.format(
        dim=VECTOR_DIM, name="user_vec", key="concat(p.user_id, '_uid')"
    ),
    "category_means": """
select c.business as id, pos, avg(coalesce(x, 0.0)) as mean
from connections c cross join (select unnest(range(%(dim)d)) as pos) d
left join (select id, unnest(embedding)::double as x, unnest(range(%(dim)d)) as at from vectors) v
  on v.id = c.node and v.at = d.pos
group by all""" % {"dim": VECTOR_DIM},
    "category_sums": """
select id, sum(mean) as s, sum(mean * (pos + 1)) as w from category_means group by id""",
    "item_mean": "select business_id, avg(stars) as m from ratings group by 1",
    "user_mean": "select user_id, avg(stars) as m from ratings group by 1",
    "baseline": """
select p.user_id, p.business_id, p.stars,
       coalesce(i.m, 3.0) as score_x, coalesce(u.m, 3.0) as score_c
from pairs p left join item_mean i on i.business_id = p.business_id
             left join user_mean u on u.user_id = p.user_id""",
    "baseline_blend": """
select user_id, business_id, stars,
       case when score_x >= 5 and score_c >= 5 then 5.0
            when score_x <= 1 and score_c <= 1 then 1.0
            else least(5.0, greatest(1.0, 0.4 * score_x::double + 0.6 * score_c::double))
       end as prediction
from baseline""",
    "rated": """
select user_id, business_id, avg(stars) as stars from ratings group by 1, 2""",
    "user_spread": """
select user_id, avg(stars) as mean, stddev_pop(stars) as spread from rated group by 1""",
    "centred": """
select r.user_id, r.business_id, r.stars - u.mean as off,
       ('0x' || substr(md5(r.user_id), 1, 8))::bigint % 64 as slot,
       case when ('0x' || substr(md5(r.user_id), 9, 1))::bigint % 2 = 0 then 1.0 else -1.0 end::double
         as sign
from rated r join user_spread u on u.user_id = r.user_id""",
    "profiles": """
select business_id, slot, sum(sign * off) as value from centred group by 1, 2""",
    "profile_lengths": """
select business_id, sqrt(sum(value * value)) as len from profiles group by 1""",
    "tastes": """
select c.user_id, p.slot, sum(p.value * c.off / l.len) as value
from centred c join profiles p on p.business_id = c.business_id
join profile_lengths l on l.business_id = c.business_id
where l.len > 1e-9 group by 1, 2""",
    "neighbour_pairs": _neighbours("pairs"),
    "neighbour_ratings": _neighbours("ratings"),
}

_SOURCE = re.compile(r"\b(?:from|join)\s+(\w+)")


def with_steps(sql: str) -> str:
    """``sql`` with the views and steps it needs as leading CTEs."""
    needed = set(_SOURCE.findall(sql))
    for name, text in reversed(STEPS.items()):
        if name in needed:
            needed |= set(_SOURCE.findall(text))
    parts = [with_views("unnest(string_split(", needed)]
    parts += [f"{name} as materialized ({text})" for name, text in STEPS.items() if name in needed]
    parts = [part for part in parts if part]
    if not parts:
        return sql
    if sql.lstrip().startswith("with spots "):
        return "with " + ",\n".join(parts) + ",\n" + sql.lstrip()[len("with "):]
    if sql.lstrip().startswith("with recursive "):
        return "with recursive " + ",\n".join(parts) + ",\n" + sql.lstrip()[len("with recursive "):]
    return "with " + ",\n".join(parts) + "\n" + sql


def _walk(directed: bool, num_walks: int, length: int, final: str) -> str:
    """Walks made one try per turn of a recursive query."""
    p, q = 0.25, 4.0
    most = max(1.0, 1.0 / q)
    extra = max(0.0, 1.0 / p - most)
    both = "" if directed else "union select d.node, s.node from all_edges e " \
        "join nodes s on s.id = e.src join nodes d on d.id = e.dst"
    return f"""with recursive nodes as materialized (
  select id, row_number() over (order by md5(id), id) - 1 as node
  from (select src as id from all_edges union select dst from all_edges) z),
links as materialized (
  select s.node as src, d.node as dst
  from all_edges e join nodes s on s.id = e.src join nodes d on d.id = e.dst {both}),
degrees as materialized (select src as node, count(*) as degree from links group by 1),
placed as materialized (
  select src, dst, row_number() over (partition by src order by dst) - 1 as pos from links),
walk as (
  select node * {num_walks} + k as walk_id, 0::bigint as step, 0::bigint as tried,
         node as prev, node as cur
  from nodes, (select unnest(range({num_walks})) as k) ks
  union all
  select walk_id, case when kept then step + 1 else step end,
         case when kept then 0 else tried + 1 end,
         case when kept then cur else prev end,
         case when kept then target else cur end
  from (
    select t.walk_id, t.step, t.tried, t.prev, t.cur,
           case when t.x >= t.bound then t.prev else n.dst end as target,
           t.step = 0 or t.degree = 1 or t.x >= t.bound or t.u2 * {most} <
             case when n.dst = t.prev then {1.0 / p}
                  when l.src is not null then 1.0 else {1.0 / q} end as kept
    from (
      select s.*, s.degree * {most} as bound,
             s.u1 * (s.degree * {most}
                     + case when s.step > 0 and b.src is not null then {extra} else 0 end) as x
      from (
        select w.*, g.degree,
               ('0x' || substr(md5(concat_ws('|', '0', w.walk_id, w.step, w.tried)), 1, 13))::bigint
                 / 4503599627370496.0::double as u1,
               ('0x' || substr(md5(concat_ws('|', '0', w.walk_id, w.step, w.tried)), 14, 13))::bigint
                 / 4503599627370496.0::double as u2
        from walk w join degrees g on g.node = w.cur
        where w.step < {length - 1}) s
      left join links b on b.src = s.cur and b.dst = s.prev) t
    join placed n on n.src = t.cur
     and n.pos = case when t.x >= t.bound then 0
                      else least(floor(t.x / {most})::bigint, t.degree - 1) end
    left join links l on l.src = t.prev and l.dst = n.dst) turn)
{final}"""


def _steps(step: int) -> str:
    return _walk(True, 250, step + 1, f"""
select w.walk_id, a.id as prev, b.id as cur
from walk w join nodes a on a.node = w.prev join nodes b on b.node = w.cur
where w.step = {step} and w.tried = 0""")


def _paths(directed: bool, num_walks: int) -> str:
    return _walk(directed, num_walks, 25, """
select walk_id, count(*) as n_nodes, string_agg(id, ' ' order by step) as path
from walk join nodes on nodes.node = walk.cur where tried = 0 group by walk_id""")


def _placed(directed: bool, num_walks: int) -> str:
    """Nodes with a vector: those on a walk of two nodes or more."""
    return _walk(directed, num_walks, 25, """
select n.id, 200 as dim, true as finite, bool_or(w.walk_id is not null) as has_length
from nodes n left join (
  select walk_id, cur, count(*) over (partition by walk_id) as n from walk where tried = 0
) w on w.cur = n.node and w.n > 1
group by n.id""")


_FOLD = """cast(('0x' || left(md5(concat_ws('|', user_id, business_id)), 8))::bigint % 4 as int)"""


def _held_out(*names: str) -> str:
    listed = ", ".join(f"'{n}'" for n in names)
    return f"""
select score, n, true as finite, true as in_range, true as below_mean_error
from (select count(*) as n from ratings where {_FOLD} = 0) r,
     (select unnest([{listed}]) as score) s"""


def _clamped(expression: str) -> str:
    return f"round(case when {expression} < 1 then 1.0 when {expression} > 5 then 5.0 " \
           f"else {expression} end, 6)"


def _blend(x: str, c: str) -> str:
    return f"""select user_id, business_id, stars,
       case when {x} >= 5 and {c} >= 5 then 5.0 when {x} <= 1 and {c} <= 1 then 1.0
            else {_clamped(f"(0.4::double * {x} + 0.6::double * {c})")} end as prediction
from model_scores"""


_ENRICHED_FINAL = """select * exclude (bid_var_stars, uid_var_stars{drop}),
       round(bid_var_stars, 6) as bid_var_stars, round(uid_var_stars, 6) as uid_var_stars
from {source}"""


def _cv(folds: int) -> str:
    return f"""
select fold, count(*) as n, round(sqrt(avg((stars - guess) * (stars - guess))), 6) as rmse
from (select a.fold, a.stars, coalesce(avg_rest, 3.0) as guess
      from (select *, cast(('0x' || left(md5(concat_ws('|', user_id, business_id)), 8))::bigint
                           % {folds} as int) as fold from ratings) a
      join (select f.fold, i.business_id,
                   sum(i.stars) filter (where i.fold <> f.fold)
                     / nullif(count(*) filter (where i.fold <> f.fold), 0) as avg_rest
            from (select unnest(range({folds})) as fold) f,
                 (select *, ('0x' || left(md5(concat_ws('|', user_id, business_id)), 8))::bigint
                            % {folds} as fold from ratings) i
            group by all) r
        on r.business_id = a.business_id and r.fold = a.fold) z
group by fold"""


_BOTH_VECTORS = f"""
select p.user_id, p.business_id, p.stars,
       {_sums('a', 'user_vec')}, {_sums('b', 'item_vec')}
from (select p.*, coalesce(v.embedding, list_resize([]::float[], {VECTOR_DIM}, 0)) as a,
             coalesce(w.embedding, list_resize([]::float[], {VECTOR_DIM}, 0)) as b
      from pairs p left join vectors v on v.id = concat(p.user_id, '_uid')
                   left join vectors w on w.id = concat(p.business_id, '_bid')) p"""

_SQL = {
    "read_ratings": "select user_id, business_id, stars from ratings",
    "read_pairs": "select user_id, business_id from pairs",
    "read_pairs_parts": "select user_id, business_id from pairs",
    "drop_header_lines": """
select concat(user_id, ',', business_id, ',', cast(cast(stars as int) as varchar)) as value
from ratings""",
    "read_business_json": "select * from business",
    "read_photo_json": """
select business_id, cast(photo_id as varchar) as photo_id, label from photo""",
    "read_reviews_json": "select * from reviews",
    "read_users_json": "select * from users",
    "read_vectors_wide": f"select id, {_sums('embedding', 'embedding')} from vectors",
    "edge_lines": "select concat(src, ' ', dst) as value from all_edges",
    "read_edge_lines": "select src, dst from all_edges",
    "vectors_wide": "select v.id, " + ", ".join(
        f"round(embedding[{i + 1}]::double, 6) as E_{i}" for i in range(VECTOR_DIM)
    ) + """
from vectors v join (select src as id from all_edges union select dst from all_edges) n
  on n.id = v.id""",
    "predictions_out": """
select user_id, business_id, round(prediction, 6) as prediction from baseline_blend""",
    "user_interactions": "select user_id, useful, funny, cool from users",
    "user_compliments": f"select user_id, {', '.join(_compliments)} from users",
    "photo_count": """
select business_id, count(*) as num_photo from photo
where label in ('inside', 'outside', 'food', 'drink') group by 1""",
    "businesses_in_scope": """
select business_id from business where business_id in (select business_id from in_scope)""",
    "users_in_scope": """
select user_id from users where user_id in (select user_id from in_scope)""",
    "category_labels": "select business_id, label from label_rows",
    "category_node_ids": "select distinct label, md5(label) as node from label_rows",
    "user_num_friends": """
select user_id, cast(len(string_split(friends, ',')) as bigint) as num_friends from users""",
    "user_years_on_site": """
select user_id, cast(2022 - cast(left(yelping_since, 4) as int) as bigint) as years_on_site
from users""",
    "typed_ids": """
select concat(user_id, '_uid') as uid, concat(business_id, '_bid') as bid from pairs""",
    "poly_hash_bucket": """
select business_id, h as id_hash, h % 10 as id_bucket, g as categories_hash
from (select business_id,
             list_reduce(list_prepend(0::bigint, list_transform(
               list_filter(string_split(business_id, ''), lambda c: c <> ''), lambda c: unicode(c)::bigint)),
               lambda a, c: (a * 131 + c) & 2147483647) as h,
             list_reduce(list_prepend(0::bigint, list_transform(
               list_filter(string_split(coalesce(categories, ''), ''), lambda c: c <> ''),
               lambda c: unicode(c)::bigint)),
               lambda a, c: (a * 131 + c) & 2147483647) as g
      from business) z""",
    "poly_hash_partitions": """
select bucket, count(*) as n
from (select list_reduce(list_prepend(0::bigint, list_transform(
               list_filter(string_split(business_id, ''), lambda c: c <> ''), lambda c: unicode(c)::bigint)),
               lambda a, c: (a * 131 + c) & 2147483647) % 10 as bucket
      from business) z
group by bucket""",
    "rows_placed_by_id": """
select business_id, bucket as id_bucket, bucket as partition
from (select business_id, list_reduce(list_prepend(0::bigint, list_transform(
               list_filter(string_split(business_id, ''), lambda c: c <> ''), lambda c: unicode(c)::bigint)),
               lambda a, c: (a * 131 + c) & 2147483647) % 10 as bucket
      from business) z""",
    "item_review_count": """
select business_id, cast(sum(review_count) as bigint) as bid_num_review from business group by 1""",
    "item_star_variance": """
select business_id, round(var_pop(stars), 6) as variance from reviews group by 1""",
    "user_star_variance": """
select user_id, round(var_pop(stars), 6) as variance from reviews group by 1""",
    "item_review_count_from_reviews": """
select business_id, count(*) as n_reviews from reviews group by 1""",
    "item_mean_stars_from_reviews": """
select business_id, round(avg(stars), 6) as mean_stars from reviews group by 1""",
    "user_credibility": """
select user_id, cast(sum(useful + funny + cool) as bigint) as credibility from reviews group by 1""",
    "user_review_count_from_reviews": """
select user_id, count(*) as n_reviews from reviews group by 1""",
    "user_mean_stars_from_reviews": """
select user_id, round(sum(stars) / count(stars), 6) as mean_stars from reviews group by 1""",
    "distinct_train_ids": """
select distinct 'user' as kind, user_id as id from ratings
union all select distinct 'business', business_id from ratings""",
    "distinct_eval_ids": """
select distinct 'user' as kind, user_id as id from pairs
union all select distinct 'business', business_id from pairs""",
    "node_ids_in_scope": """
select distinct 'user' as kind, concat(user_id, '_uid') as id from in_scope
union all select distinct 'business', concat(business_id, '_bid') from in_scope""",
    "item_features": """
select * exclude (bid_var_stars), round(bid_var_stars, 6) as bid_var_stars from item_eval""",
    "user_features": """
select * exclude (uid_var_stars), round(uid_var_stars, 6) as uid_var_stars from user_eval""",
    "train_pairs_enriched": _ENRICHED_FINAL.format(source="train_enriched", drop=""),
    "eval_pairs_enriched": _ENRICHED_FINAL.format(source="eval_enriched", drop=", stars"),
    "category_connections": "select business, node from connections",
    "category_mean_vector": """
select id, pos, round(mean, 6) as mean from category_means""",
    "pairs_with_user_vector": f"""
select user_id, business_id, stars, {_sums('user_vec', 'user_vec')} from user_vectors""",
    "pairs_with_item_vector": f"""
select p.user_id, p.business_id, p.stars, cast({VECTOR_DIM} as bigint) as item_vec_size,
       round(coalesce(c.s, 0.0), 5) as item_vec_sum,
       round(coalesce(c.w, 0.0), 4) as item_vec_weighted
from pairs p left join category_sums c on c.id = concat(p.business_id, '_bid')""",
    "pairs_with_business_vector": f"""
select p.user_id, p.business_id, p.stars, {_sums('e', 'item_vec')}
from (select p.*, coalesce(v.embedding, list_resize([]::float[], {VECTOR_DIM}, 0)) as e
      from pairs p left join vectors v on v.id = concat(p.business_id, '_bid')) p""",
    "pairs_with_both_vectors": _BOTH_VECTORS,
    "pairs_with_stored_vectors": _BOTH_VECTORS,
    "pairs_with_side_score": """
select p.user_id, p.business_id, p.stars, coalesce(s.score, 3.0) as score
from pairs p left join side_scores s
  on s.user_id = p.user_id and s.business_id = p.business_id""",
    "category_edges": "select src, dst from category_pairs",
    "friend_edges": "select src, dst from friend_pairs",
    "rating_edges": "select src, dst from rating_pairs",
    "edges": "select src, dst from all_edges",
    "graph_nodes": "select src as id from all_edges union select dst from all_edges",
    "out_degree": "select src as id, count(*) as out_degree from all_edges group by 1",
    **{f"biased_walk_step{step}": _steps(step) for step in (1, 2, 3, 4)},
    "walk_paths": _paths(True, 250),
    "walk_paths_undirected": _paths(False, 25),
    "one_hot_open": """
select business_id, is_open, case when is_open = 0 then 1 else 0 end as is_open_0,
       case when is_open = 1 then 1 else 0 end as is_open_1
from item_eval""",
    "one_hot_city": "select business_id, " + ", ".join(
        f"case when city = 'Brand#{n}' then 1 else 0 end as city_Brand_{n}"
        for n in range(1, 26)
    ) + " from business",
    "feature_matrix": f"""
select e.user_id, e.business_id, e.stars, {', '.join('e.' + c for c in SCALARS)},
       case when e.is_open = 0 then 1 else 0 end as is_open_0,
       case when e.is_open = 1 then 1 else 0 end as is_open_1,
       {_sums('e.user_vec', 'user_vec')}, cast({VECTOR_DIM} as bigint) as item_vec_size,
       round(coalesce(c.s, 0.0), 5) as item_vec_sum,
       round(coalesce(c.w, 0.0), 4) as item_vec_weighted
from (select z.*, coalesce(v.embedding, list_resize([]::float[], {VECTOR_DIM}, 0)) as user_vec
      from eval_enriched z left join vectors v on v.id = concat(z.user_id, '_uid')) e
left join category_sums c on c.id = concat(e.business_id, '_bid')""",
    "standardised_vectors": f"""
with spots as materialized (
  select i, avg(coalesce(v.embedding[i], 0)::double) as m, stddev_pop(coalesce(v.embedding[i], 0)::double) as s
  from ratings r cross join (select unnest(range(1, {VECTOR_DIM + 1})) as i) d
  left join vectors v on v.id = concat(r.user_id, '_uid') group by i),
lists as (
  select list(m order by i) as m, list(case when s = 0 then 1.0 else s end order by i) as s from spots)
select user_id, business_id, stars, {_sums('z', 'user_vec')}
from (select p.user_id, p.business_id, p.stars,
             list_transform(p.user_vec, lambda x, i: (x::double - l.m[i]) / l.s[i]) as z
      from user_vectors p, lists l) q""",
    "standardised_features": "select e.user_id, e.business_id, " + ", ".join(
        f"round((e.{c} - s.m_{c}) / case when s.s_{c} = 0 then 1.0 else s.s_{c} end, 6) as {c}"
        for c in SCALARS
    ) + " from eval_enriched e, (select " + ", ".join(
        f"avg({c}) as m_{c}, stddev_pop({c}) as s_{c}" for c in SCALARS
    ) + " from train_enriched) s",
    "blend_clamp": _blend("score_x", "score_c"),
    "blend_clamp_inputs": _blend(
        "least(5.0, greatest(1.0, score_x))", "least(5.0, greatest(1.0, score_c))"
    ),
    "blend_three_way": """
select user_id, business_id, stars,
       round(case when score_n = -1
                  then (0.8::double * score_x + 0.1::double * score_c) / 0.9::double
                  else 0.8::double * score_x + 0.1::double * score_c + 0.1::double * score_n
             end, 6) as prediction
from model_scores""",
    "item_profiles": """
select business_id, slot, round(value, 6) as value from profiles where round(value, 6) <> 0""",
    "neighbour_scores": """
select user_id, business_id, round(score, 6) as score from neighbour_pairs""",
    "neighbour_scores_of_ratings": """
select user_id, business_id, round(score, 6) as score from neighbour_ratings""",
    "blend_with_neighbours": """
select b.user_id, b.business_id, b.stars,
       round(case when n.score = -1
                  then (0.8::double * score_x + 0.1::double * score_c) / 0.9::double
                  else 0.8::double * score_x + 0.1::double * score_c + 0.1::double * n.score
             end, 6) as prediction
from baseline b join neighbour_pairs n
  on n.user_id = b.user_id and n.business_id = b.business_id""",
    "rmse_eval": """
select count(*) as n, round(sqrt(avg((t.stars - b.prediction) * (t.stars - b.prediction))), 6) as rmse
from pairs t join baseline_blend b
  on b.user_id = t.user_id and b.business_id = t.business_id""",
    "node_vectors": _placed(True, 250),
    "linked_nodes_nearer": "select count(*) as n_links, true as nearer from all_edges",
    "node_vectors_skip_gram": _placed(True, 250),
    "node_vectors_factorised": _placed(False, 1),
    "model1_scores": _held_out("model1"),
    "model2_scores": _held_out("model2"),
    "blended_model_scores": _held_out("score_x", "score_c", "blend"),
    "model1_cross_validated": f"""
select {_FOLD} as fold, count(*) as n, true as below_mean_error from ratings group by 1""",
    "model_grid_search": f"""
select concat('depth=8,rate=', rate, ',column_share=0.4,row_share=0.6') as name, fold, true as below_mean_error
from (select unnest(['0.1', '0.12']) as rate) g, (select distinct {_FOLD} as fold from ratings) f""",
    "model_round_trip": """
select e.user_id, e.business_id, e.stars,
       3.0::double
       + case when bid_avg_stars > 3.0 then 0.5 when uid_avg_stars <= 2.5 then -1.0 else -0.25 end::double
       + case when num_photo <= 1 then -0.125 when uid_num_reviews <= 20 then 0.0625 else 0.375 end::double
       + case when is_open <> 0 then 0.03125
              when coalesce(v.embedding[1], 0) <= 0 then 0.015625 else -0.015625 end::double as prediction
from eval_enriched e left join vectors v on v.id = concat(e.user_id, '_uid')""",
    "train_rmse": """
select count(*) as n, round(sqrt(avg((r.stars - i.m) * (r.stars - i.m))), 6) as rmse
from ratings r join item_mean i on i.business_id = r.business_id""",
    "cv_fold_rmse": _cv(4),
    "cv_fold_rmse_10": _cv(10),
}

CHECKS = {name: with_steps(sql) for name, sql in _SQL.items()}
