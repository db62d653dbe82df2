"""Named queries over the driver's tables, each beside the SQL another engine runs on the same files."""

QUERIES = {}
ORACLE = {}


def query(name, sql=None):
    """Registers a `(read, spark) -> DataFrame` builder; `read(table)` opens one of the tables, `read.path(table)` names it."""

    def register(build):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark, folder):
            def read(table):
                return spark.read.parquet(read.path(table))

            read.path = lambda table: f"{folder}/{table}.parquet"
            return build(read, spark)

        run.__name__ = build.__name__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return build

    return register
