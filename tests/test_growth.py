"""What is shuffled, and how evenly work is spread, on inputs that a larger table makes common."""

import random

from pyspark.sql import functions as F

from weftline.operators import mining
from weftline.plans import routes


def shuffled(spark, run) -> int:
    """Rows that a job sends between tasks."""
    sc, group = spark.sparkContext, f"growth-{random.random()}"
    sc.setJobGroup(group, group)
    try:
        run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store, total = sc._jsc.sc().statusStore(), 0
    for stage in {s for j in sc.statusTracker().getJobIdsForGroup(group) for s in sc.statusTracker().getJobInfo(j).stageIds}:
        total += store.lastStageAttempt(stage).shuffleWriteRecords()
    return total


def test_imports_are_not_sent_once_a_candidate(spark):
    """Each specifier has 23 candidates; it is sent about once, and what it means stays the same."""
    r = random.Random(5)
    ends = ("", ".js", ".ts", ".css", "/index.jsx", "/index.js", ".json", "x")
    paths = sorted({f"src/d{r.randrange(4)}/m{i}{r.choice(ends)}" for i in range(150)} | {"src/d0/m1.ts", "src/d0/m1.js", "src/d0/m1/index.js", ".js", "/index.js", "index.ts"})
    specs = ["./m1", "../d0/m1", "@/d0/m1.js", "pkg", ".", "..", "/", "../../index", "@/"] + [r.choice(("./m", "@/d1/m", "../d2/m", "/src/d3/m")) + str(r.randrange(170)) + r.choice(ends) for _ in range(300)]
    texts = [(p, "\n".join(f"import '{s}';" for s in r.sample(specs, 40))) for p in paths]
    s = spark.createDataFrame(texts + texts[:3] + [(None, "import './m1'")], "path string, text string")
    edges, lost = routes.import_edges(s)
    want, missing = set(), []
    for p, t in texts + texts[:3]:
        if not p.endswith((".js", ".jsx", ".ts", ".css")):
            continue
        for spec in routes.specifiers(p, t):
            tried = routes.resolution_candidates(p, spec, {"@/": "src/"})
            hit = next((c for c in tried if c in paths), None)
            if hit:
                want.add((p, hit))
            elif tried:
                missing.append((p, spec))
    assert sorted(map(tuple, edges.collect())) == sorted(want) and len(want) > 50
    assert sorted(map(tuple, lost.collect())) == sorted(missing) and len(missing) > 100
    n = sum(len(routes.specifiers(p, t)) for p, t in texts)
    assert shuffled(spark, lambda: edges.agg(F.count("*")).collect()) < 4 * n
    assert shuffled(spark, lambda: lost.agg(F.count("*")).collect()) < 4 * n


def by_task(df) -> list[int]:
    """Rows of each task that returns any, most first."""
    return sorted((r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()), reverse=True)


def test_equal_values_of_one_large_group_are_paired_by_many_tasks(spark):
    r = random.Random(6)
    names = [(f"n{i:05d}", "#fff", "#000") for i in range(2500)] + [(f"m{i}", r.choice("abc"), r.choice("ab")) for i in range(60)]
    names += names[:2] + [(None, "#fff", "#000"), (None, "a", "a"), ("x", None, "a"), ("y", None, "a"), ("z", "a", None), ("one", "q", "q")]
    r.shuffle(names)
    got = mining.equal_values(spark.createDataFrame(names, "name string, light string, dark string"))
    tasks = by_task(got)
    assert len(tasks) >= 4 and tasks[0] < sum(tasks) / 2
    groups: dict = {}
    for n, *values in names:
        groups.setdefault(tuple(values), []).append(n)
    want = sorted((a, b) for v, ns in groups.items() if None not in v for a in ns for b in ns if a and b and a < b)
    assert sorted((t.a, t.b) for t in got.toPandas().itertuples()) == want and len(want) > 3_000_000
