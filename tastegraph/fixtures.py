"""The engine's input tables, derived from the benchmark's parquet tables.

The view texts are fixed values: the same SQL gives the same rows on Spark and
on the SQL engine used for checking, so they are kept as text in one place.
"""

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastegraph.config import COMPLIMENTS
from tastegraph.operators.joins import ordered_index

TABLES = ["customer", "part", "orders", "lineitem", "events", "embeddings"]

_compliments = ",\n       ".join(
    f"(c_custkey + {i}) % 13 as compliment_{name}" for i, name in enumerate(COMPLIMENTS, 1)
)

VIEWS = {
    "ratings_all": """
select concat('u', cast(o.o_custkey as varchar(20))) as user_id,
       concat('b', cast(l.l_partkey as varchar(20))) as business_id,
       cast(1 + cast(l.l_quantity as int) % 5 as double) as stars,
       l.l_linenumber as useful,
       cast(round(l.l_discount * 100) as int) as funny,
       cast(round(l.l_tax * 100) as int) as cool,
       case when l.l_linenumber <= 5 then 'train' else 'eval' end as split
from lineitem l join orders o on l.l_orderkey = o.o_orderkey""",
    "ratings": """
select user_id, business_id, stars from ratings_all where split = 'train'""",
    "pairs": """
select user_id, business_id, stars from ratings_all where split = 'eval'""",
    "reviews": """
select user_id, stars, useful, funny, cool, business_id
from ratings_all
where split = 'train' and user_id not like '%7'
  and (business_id not like '%7' or (stars = 5 and cool = 0))""",
    "business": """
select concat('b', cast(p_partkey as varchar(20))) as business_id,
       p_size as review_count,
       cast(1.0 + (p_partkey % 9) / 2.0 as double) as stars,
       p_brand as city,
       p_size % 2 as is_open,
       case when p_partkey % 17 = 0 then null
            when p_partkey % 19 = 0 then ''
            else concat(p_type, ' & ', p_brand, ', ', replace(p_name, ' ', '/'),
                        ' (', lower(p_type), '), Café &Bar',
                        case when p_partkey % 7 = 0 then ', café &bar' else '' end)
       end as categories
from part where p_partkey % 10 <> 0""",
    "photo": """
select concat('b', cast(user_id as varchar(20))) as business_id,
       event_id as photo_id,
       case event_type when 'click' then 'food' when 'view' then 'inside'
                       when 'purchase' then 'drink' when 'error' then 'menu'
                       else 'outside' end as label
from events""",
    "users": f"""
select concat('u', cast(c_custkey as varchar(20))) as user_id,
       c_custkey % 50 as review_count,
       cast(1.0 + (c_custkey % 9) / 2.0 as double) as average_stars,
       c_custkey % 7 as fans,
       case when c_custkey % 11 = 0 then 'None'
            else concat('u', cast((c_custkey + 1) % 2000 as varchar(20)),
                        ', u', cast((c_custkey * 7) % 2000 as varchar(20))) end as friends,
       c_custkey % 3 as useful, c_custkey % 4 as funny, c_custkey % 5 as cool,
       {_compliments},
       concat(cast(2004 + c_custkey % 15 as varchar(20)), '-01-15') as yelping_since
from customer where c_custkey % 10 <> 0""",
    "label_rows": """
select business_id, lower(trim(l)) as label
from (select business_id,
             {EXPLODE_OPEN}replace(replace(replace(replace(replace(
               categories, '&', ' '), '/', ' '), '(', ''), ')', ''), '  ', ''), ',')) as l
      from business where categories is not null) z""",
    "vectors": """
select concat('u', cast(vec_id as varchar(20)), '_uid') as id, embedding
from embeddings where vec_id % 2 = 0
union all
select concat('b', cast(vec_id as varchar(20)), '_bid'), embedding
from embeddings where vec_id % 2 = 1
union all
select md5(d.label), e.embedding
from (select label, row_number() over (order by md5(label), label) as rn
      from (select distinct label from label_rows) q) d
join embeddings e on e.vec_id = d.rn where d.rn % 2 = 0""",
    "side_scores": """
select user_id, business_id, cast(1 + count(*) % 5 as double) as score
from ratings_all where split = 'eval'
group by user_id, business_id having min(useful) = 6""",
    "model_scores": """
select user_id, business_id, stars,
       cast(stars * 1.3 - 0.6 as double) as score_x,
       cast(0.1 + funny % 7 as double) as score_c,
       cast(case when useful = 6 then -1.0 else stars end as double) as score_n
from ratings_all where split = 'eval'""",
}

VECTOR_DIM = 64


_SOURCE = re.compile(r"\b(from|join) (\w+)")


def with_views(explode_open: str, needed: set[str]) -> str:
    """The needed views, and those below them, as the body of a WITH clause."""
    wanted = set(needed)
    for name, text in reversed(VIEWS.items()):
        if name in wanted:
            wanted |= {source for _, source in _SOURCE.findall(text)}
    return ",\n".join(
        f"{name} as ({text.replace('{EXPLODE_OPEN}', explode_open)})"
        for name, text in VIEWS.items() if name in wanted
    )


class Fixtures:
    """The input tables at one scale, as lazy DataFrames, each planned once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        elif name in VIEWS:
            text = VIEWS[name].replace("{EXPLODE_OPEN}", "explode(split(")
            sources = {source for _, source in _SOURCE.findall(text)} & (set(VIEWS) | set(TABLES))
            text = _SOURCE.sub(
                lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in sources else m[0], text
            )
            df = self.spark.sql(text, **{source: getattr(self, source) for source in sources})
        else:
            raise AttributeError(name)
        setattr(self, name, df)
        return df

    @cached_property
    def vectors(self) -> DataFrame:
        """As the view text, with the labels numbered bucket by bucket."""
        labels = self.label_rows.select("label").distinct()
        labels = labels.withColumn("md5", F.md5(F.col("label").cast("binary")))
        numbered = ordered_index(labels, ["md5", "label"], F.substring("md5", 1, 4), "rn")
        embeddings = self.embeddings.select("vec_id", "embedding")
        ids = F.when(F.col("vec_id") % 2 == 0, F.concat(F.lit("u"), F.col("vec_id"), F.lit("_uid")))
        own = embeddings.select(
            ids.otherwise(F.concat(F.lit("b"), F.col("vec_id"), F.lit("_bid"))).alias("id"),
            "embedding",
        )
        of_labels = (
            numbered.withColumn("vec_id", F.col("rn") + 1)
            .where("vec_id % 2 = 0")
            .join(embeddings, "vec_id")
            .select(F.col("md5").alias("id"), "embedding")
        )
        return own.unionByName(of_labels)
