"""Command line: ``python -m trialframe.cli <command>``."""

from __future__ import annotations

import argparse
import json
import sys
import threading

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from trialframe.errors import TrialframeError
from trialframe.operators import designs
from trialframe.operators.runstore import RunStore, artifacts_under, current_states
from trialframe.plans.study import DurableRunner
from trialframe.sources.artifacts import ArtifactStore
from trialframe.sources.config import Experiment
from trialframe.sources.exchange import export_tree


def _session() -> SparkSession:
    return SparkSession.builder.appName("trialframe").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def _rows(df) -> list[dict]:
    return [json.loads(x) for x in df.toJSON().collect()]


def _plans(spark: SparkSession, experiment: Experiment):
    space = experiment.build_space()
    if space is None:
        return spark.createDataFrame([("trial-0",)], "trial_id string")
    return designs.propose(spark, space, experiment.request(), experiment.build_planner())


def run_experiment(spark: SparkSession, experiment: Experiment, resume: bool = False) -> dict:
    """All trials through the pipeline at once; outputs of the last node by trial."""
    from pyspark.sql import types as T

    pipeline = experiment.build_pipeline()
    roots = [n for n in pipeline.order() if not n.depends_on]
    if len(roots) != 1:
        raise TrialframeError("an experiment's pipeline has exactly one root")
    plans = _plans(spark, experiment)
    initial = plans.select(F.col("trial_id").alias("run_id"))
    fields = [f for f in roots[0].block.inputs if f.name in experiment.initial_input]
    for f in fields:
        text = json.dumps({"v": experiment.initial_input[f.name]})
        initial = initial.withColumn(f.name, F.from_json(F.lit(text), T.StructType([T.StructField("v", f.dataType)]))["v"])
    root = experiment.storage.get("root")
    if root:
        result = DurableRunner(spark, RunStore(spark, f"{root}/state"), root).run(pipeline, initial, resume=resume, signals=threading.current_thread() is threading.main_thread())
        return {"experiment": experiment.name, "hits": list(result.hits), "resumed": list(result.resumed), "trials": _rows(result.final)}
    outputs = pipeline.run(initial)
    return {"experiment": experiment.name, "hits": [], "resumed": [], "trials": _rows(outputs[pipeline.order()[-1].id])}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="trialframe")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("validate", "run", "resume"):
        sub.add_parser(name).add_argument("config")
    plan = sub.add_parser("plan")
    plan.add_argument("config")
    plan.add_argument("--out")
    sub.add_parser("schema")
    for name in ("status", "reconcile", "export", "inspect", "pause", "cancel", "retry", "verify", "lineage"):
        p = sub.add_parser(name)
        p.add_argument("root")
        if name in ("export", "inspect", "pause", "cancel", "retry", "lineage"):
            p.add_argument("id")
        if name == "reconcile":
            p.add_argument("--requeue", action="store_true")
    args = parser.parse_args(argv)
    try:
        out = _dispatch(args, spark)
    except TrialframeError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    print(json.dumps(out, indent=1, default=str))
    return 0


def _dispatch(args: argparse.Namespace, spark: SparkSession | None):
    if args.command == "schema":
        return Experiment.json_schema()
    if args.command == "validate":
        experiment = Experiment.from_json(args.config)
        return {"valid": True, "order": [n.id for n in experiment.build_pipeline().order()]}
    spark = spark or _session()
    if args.command in ("run", "resume"):
        return run_experiment(spark, Experiment.from_json(args.config), args.command == "resume")
    if args.command == "plan":
        plans = _plans(spark, Experiment.from_json(args.config))
        if args.out:
            plans.write.mode("error").json(args.out)
            return {"trials": plans.count(), "path": args.out}
        return _rows(plans)
    store = RunStore(spark, f"{args.root}/state")
    if args.command == "status":
        return _rows(store.table("runs").join(current_states(store.table("events")), "run_id").groupBy("kind", "state").count().orderBy("kind", "state"))
    if args.command == "inspect":
        return {"state": store.state(args.id).asDict(), "events": _rows(store.events(args.id)), "metrics": _rows(store.metrics(args.id)), "artifacts": _rows(artifacts_under(store.table("runs"), store.artifacts(), args.id))}
    if args.command == "reconcile":
        return {"stale": [r.run_id for r in store.reconcile_stale(requeue=args.requeue).toLocalIterator()]}
    if args.command == "pause":
        return {"version": store.transition(args.id, "pausing")}
    if args.command == "cancel":
        return {"version": store.transition(args.id, "cancelled")}
    if args.command == "retry":
        return {"version": store.transition(args.id, "queued")}
    if args.command == "export":
        return [{"kind": r.kind, **json.loads(r.document)} for r in export_tree(store.table("runs"), store.artifacts(), args.id).toLocalIterator()]
    artifacts = ArtifactStore(spark, f"{args.root}/artifacts")
    if args.command == "verify":
        return {"corrupt": [r.content_hash for r in artifacts.payloads().where("not whole").collect()]}
    return {"lineage": {r.run_id: r.lineage for r in store.artifacts().where(F.col("content_hash") == args.id).collect()}}


if __name__ == "__main__":
    sys.exit(main())
