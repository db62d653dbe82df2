"""Balanced sizes, draws, splits and samples."""

from pyspark.sql import functions as F

from labelspark.catalog import inputs as I
from labelspark.catalog.registry import query
from labelspark.operators import generated as GO
from labelspark.operators import split as S

RANKED = f"""
{I.LONG},
ranked as (
  select *, row_number() over (partition by task, value order by md5(concat(cast(doc_id as varchar), '-42'))) as r,
         count(*) over (partition by task, value) as n
  from long
),
splits as (
  select doc_id, task, value,
         case when r <= floor(n * 0.7) then 'train' when r <= floor(n * 0.85) then 'validation' else 'test' end as split
  from ranked
)"""

HEX = "cast('0x' || substr(md5(concat_ws('|', '42', task, cast(value as varchar), cast(j as varchar))), 1, 15) as bigint)"


def draw_sql(source, sizes):
    """Draws j = 0..size-1 per class of `source`, each a position in md5 order."""
    return f"""
    placed as (select doc_id, task, value,
      row_number() over (partition by task, value order by md5(concat(cast(doc_id as varchar), '-42'))) as pos
      from {source}),
    draws as (select task, value, n, unnest(range(cast(size as bigint))) as j from {sizes}),
    picked as (select task, value, {HEX} % n + 1 as pos from draws),
    balanced as (
      select p.doc_id, p.task, p.value, row_number() over (partition by p.doc_id, p.task) as copy
      from picked k join placed p on p.task = k.task and p.value = k.value and p.pos = k.pos)"""


SIZES = """
counted as (select task, value, count(*) as n from {source} group by all),
sized as (select *, min(n) over (partition by task) as least,
                 row_number() over (partition by task order by n, value) = 1 as smallest from counted),
sizes as (select task, value, n, case when smallest then least else ceil(least * 1.5) end as size from sized)"""

GROWN = """
counted as (select task, value, count(*) as n from {source} group by all),
sized as (select *, min(n) over (partition by task) as least,
                 row_number() over (partition by task order by n, value) = 1 as smallest from counted),
stepped as (select *, sum(case when smallest then 0 else 1 end) over (partition by task order by value) as steps from sized),
grown as (
  with recursive g(task, step, size) as (
    select distinct task, 0, cast(least as double) from sized
    union all select task, step + 1, ceil(size * 1.5) from g where step < 40
  ) select * from g),
sizes as (select s.task, s.value, s.n, g.size from stepped s join grown g on g.task = s.task and g.step = s.steps)"""


@query("balanced_sizes", f"with {I.LONG}, {SIZES.format(source='long')} select task, value, n, cast(size as bigint) as size from sizes")
def balanced_sizes(read, spark):
    return S.balanced_sizes(I.long(read), ratio=1.5)


CLASSES = "classes as (select doc_id, 'lang' as task, lang as value from documents)"


def classes(read):
    return read("documents").select("doc_id", F.lit("lang").alias("task"), F.col("lang").alias("value"))


@query(
    "balanced_sizes_compounding",
    f"with recursive {CLASSES}, {GROWN.format(source='classes')} select task, value, n, cast(size as bigint) as size from sizes",
)
def balanced_sizes_compounding(read, spark):
    return S.balanced_sizes(classes(read), ratio=1.5, compounding=True)


@query(
    "balance",
    f"with {I.LONG}, {SIZES.format(source='long')}, {draw_sql('long', 'sizes')} select doc_id, task, value, copy from balanced",
)
def balance(read, spark):
    return S.balance(I.long(read), "doc_id", ratio=1.5)


@query(
    "balance_compounding",
    f"with recursive {CLASSES}, {GROWN.format(source='classes')}, {draw_sql('classes', 'sizes')} select doc_id, task, value, copy from balanced",
)
def balance_compounding(read, spark):
    return S.balance(classes(read), "doc_id", ratio=1.5, compounding=True)


@query("stratified_split", f"with {RANKED} select * from splits")
def stratified_split(read, spark):
    return S.stratified_split(I.long(read), "doc_id")


@query(
    "random_split",
    """with ranked as (select doc_id, row_number() over (order by md5(concat(cast(doc_id as varchar), '-42'))) as r,
                              count(*) over () as n from documents)
    select doc_id, case when r <= floor(n * 0.7) then 'train' when r <= floor(n * 0.85) then 'validation' else 'test' end as split
    from ranked""",
)
def random_split(read, spark):
    return S.random_split(read("documents").select("doc_id"), "doc_id")


@query(
    "grouped_split",
    """with groups as (select text, min(lang) as stratum from documents group by text),
    ranked as (select text, row_number() over (partition by stratum order by md5(concat(text, '-42'))) as r,
                      count(*) over (partition by stratum) as n from groups),
    named as (select text, case when r <= floor(n * 0.7) then 'train' when r <= floor(n * 0.85) then 'validation' else 'test' end as split
              from ranked)
    select doc_id, split from documents join named using (text)""",
)
def grouped_split(read, spark):
    """Copies of one text stay in one split."""
    docs = read("documents").select("doc_id", "text", "lang")
    return S.stratified_split(docs, "doc_id", "lang", None, group_col="text").select("doc_id", "split")


@query(
    "seeded_split",
    """with ranked as (select doc_id, row_number() over (order by md5(concat(cast(doc_id as varchar), '-7'))) as r,
                              count(*) over () as n from documents)
    select doc_id, case when r <= floor(n * 0.6) then 'train' when r <= floor(n * 0.9) then 'validation' else 'test' end as split
    from ranked""",
)
def seeded_split(read, spark):
    return S.seeded_split(read("documents").select("doc_id"), "doc_id", 0.6, 0.3, seed=7)


TASKS = f"""{I.LONG},
every as (select * from long union all select page_id, split_part(url, '/', 3), 1 from pages
          union all select page_id, split_part(url, '/', 3), 0 from pages where contains(html, '***'))"""


def every_task(read):
    """Label tasks together with one small task per web host."""
    host = F.split_part("url", F.lit("/"), F.lit(3))
    pages = read("pages").select(F.col("page_id").alias("doc_id"), host.alias("task"), "html")
    ones = pages.select("doc_id", "task", F.lit(1).alias("value"))
    zeros = pages.where(F.contains("html", F.lit("***"))).select("doc_id", "task", F.lit(0).alias("value"))
    return I.long(read).unionByName(ones).unionByName(zeros)


@query(
    "split_every_task",
    f"""with {TASKS},
    counted as (select task, value, count(*) as n from every group by all),
    good as (select task from counted group by task having min(least(floor(n * 0.7), n - floor(n * 0.7))) >= 2),
    ranked as (select e.*, row_number() over (partition by task, value order by md5(concat(cast(doc_id as varchar), '-42'))) as r,
                      count(*) over (partition by task, value) as n from every e join good using (task))
    select doc_id, task, value,
           case when r <= floor(n * 0.7) then 'train' when r <= floor(n * 0.85) then 'validation' else 'test' end as split
    from ranked""",
)
def split_every_task(read, spark):
    return S.split_every_task(every_task(read), "doc_id")[0]


@query(
    "split_skipped_tasks",
    f"""with {TASKS}, counted as (select task, value, count(*) as n from every group by all)
    select task, min(n) as smallest_class from counted group by task
    having min(least(floor(n * 0.7), n - floor(n * 0.7))) < 2""",
)
def split_skipped_tasks(read, spark):
    return S.split_every_task(every_task(read), "doc_id")[1]


@query(
    "split_then_balance",
    f"""with {RANKED}, train as (select * from splits where split = 'train'),
    {SIZES.format(source='train')}, {draw_sql('train', 'sizes')}
    select doc_id, task, value, copy, 'train' as split from balanced
    union all select doc_id, task, value, 1, split from splits where split <> 'train'""",
)
def split_then_balance(read, spark):
    """Only train rows are drawn, so no row is in two splits."""
    return S.split_every_task(I.long(read), "doc_id", ratio=1.5)[0].select("doc_id", "task", "value", "copy", "split")


@query(
    "augment_train",
    f"""with {RANKED}, extra as (select conv_id as doc_id, case role when 'user' then 'toxic' when 'system' then 'quality' else role end as task from conversations)
    select doc_id, task, value, split from splits
    union all select doc_id, task, 1, 'train' from extra where task in (select task from long)""",
)
def augment_train(read, spark):
    return _augmented(read)[0].select("doc_id", "task", "value", "split")


@query("augment_train_skipped", "select role as task, count(*) as n from conversations where role not in ('user', 'system') group by role")
def augment_train_skipped(read, spark):
    return _augmented(read)[1]


def _augmented(read):
    task = F.when(F.col("role") == "user", "toxic").when(F.col("role") == "system", "quality").otherwise(F.col("role"))
    extra = read("conversations").select(F.col("conv_id").alias("doc_id"), task.alias("task"))
    return GO.augment_train(S.stratified_split(I.long(read), "doc_id"), extra)


@query("first_rows", "select doc_id, lang, md5(text) as text_md5 from documents order by doc_id limit 30")
def first_rows(read, spark):
    return S.first_rows(read("documents"), "doc_id", 30).select("doc_id", "lang", F.md5("text").alias("text_md5"))


@query(
    "sample_rows",
    f"""with rows as (select doc_id, 'rows' as task, 'all' as value from documents),
    counted as (select task, value, count(*) as n, 30 as size from rows group by all), {draw_sql('rows', 'counted')}
    select doc_id, copy from balanced""",
)
def sample_rows(read, spark):
    return S.sample_rows(read("documents").select("doc_id"), "doc_id", 30)
