"""Hand-made tables for edge-case tests."""

from shiftwise import schemas
from shiftwise.sources.tables import Tables


def make_tables(spark, **rows) -> Tables:
    """Tables from lists of dicts; tables not given are empty."""
    frames = {}
    for name, schema in schemas.ALL.items():
        data = [tuple(r.get(f.name) for f in schema.fields) for r in rows.get(name, [])]
        frames[name] = spark.createDataFrame(data, schema)
    return Tables.from_frames(**frames)


def rows(df) -> list[tuple]:
    """Rows in an order of their own, columns by name."""
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=str)


def scan_metrics(df) -> list[dict]:
    """Runs ``df``; per file scan that ran: columns read, files and rows read."""
    df.collect()
    found, seen = [], set()

    def walk(node) -> None:
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        if name == "ReusedExchangeExec":
            return None
        if name == "FileSourceScanExec" and node.id() not in seen:
            seen.add(node.id())
            metric = {m: node.metrics().apply(m).value() for m in ("numFiles", "numOutputRows")}
            schema = node.requiredSchema()
            found.append({"columns": list(schema.fieldNames()), "files": metric["numFiles"], "rows": metric["numOutputRows"]})
        kids = node.children()
        for i in range(kids.size()):
            walk(kids.apply(i))
        return None

    walk(df._jdf.queryExecution().executedPlan())
    return found


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
