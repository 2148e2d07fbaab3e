"""Names of the registered queries, with the SQL each is checked against."""

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, folder of tables) -> DataFrame under `name`."""

    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register
