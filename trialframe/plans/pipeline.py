"""Typed dataflow graphs over DataFrames: a block maps a table of runs to a table of runs.

Every table carries ``run_id``: one row is one run's value of a port, so all trials go through the
graph together and Catalyst sees the whole of it as one plan. Mapped blocks see a row per list item.
"""

from __future__ import annotations

import inspect
from collections import deque
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialframe.context import Context
from trialframe.errors import PipelineInvalid, PortMismatch, ResourceError
from trialframe.functions.canonical import code_fingerprint, fingerprint
from trialframe.operators import reductions
from trialframe.plans import resources
from trialframe.schemas import missing_fields, problems, repeated, schema, strict

PATTERNS = ("batch", "map", "reduce", "map_reduce", "service_call", "subprocess", "stream")


@dataclass(frozen=True)
class Block:
    """A function of a DataFrame (and a context) with declared columns. ``NOT NULL`` input fields are required."""

    name: str
    function: Callable
    inputs: T.StructType
    outputs: T.StructType
    version: str = "1"
    pattern: str = "batch"
    trigger: str | None = None
    checkpoint: str | None = None
    #: Versions of what the function needs besides its code, for the cache key.
    dependencies: str | None = None
    #: How durable runs use the cache for this block; as the runner does where it says nothing.
    cache: str | None = None

    @property
    def code(self) -> str:
        return code_fingerprint(self.function, self.version)

    @property
    def takes_context(self) -> bool:
        return isinstance(self.function, Stateful) or len(inspect.signature(self.function).parameters) > 1

    def __call__(self, df: DataFrame, context=None) -> DataFrame:
        if isinstance(self.function, Stateful):
            return self.function.run(df, context)
        return self.function(df, context) if self.takes_context else self.function(df)


class Stateful:
    """Base of a block's function that holds what it sets up once: ``setup`` comes before the first ``process``."""

    _ready = False

    def setup(self, context) -> None:
        """Prepare what ``process`` needs."""

    def process(self, df: DataFrame, context) -> DataFrame:
        return df

    def run(self, df: DataFrame, context=None) -> DataFrame:
        if not self._ready:
            self.setup(context)
            self._ready = True
        return self.process(df, context)

    def __getstate__(self) -> dict:
        """Its parameters, without what was set up: also what its code's fingerprint sees."""
        return {k: v for k, v in vars(self).items() if not k.startswith("_")}


def block(name: str, inputs: str, outputs: str, **options) -> Callable[[Callable], Block]:
    """Declare a block around a function; ports are DDL strings."""
    return lambda f: Block(name, f, schema(inputs), schema(outputs), **options)


@dataclass(frozen=True)
class Node:
    id: str
    block: Block
    depends_on: tuple[str, ...] = ()
    map_over: str | None = None
    parallelism: int = 1
    resources: Mapping[str, float] = field(default_factory=dict)


class Pipeline:
    """A graph of blocks, built in order with ``then`` or explicitly with ``add``."""

    def __init__(self, name: str, version: str = "1") -> None:
        self.name, self.version = name, version
        self.nodes: dict[str, Node] = {}
        self._tips: tuple[str, ...] = ()

    def add(self, id: str, block: Block, depends_on: Sequence[str] = (), map_over: str | None = None, parallelism: int = 1, resources: Mapping[str, float] | None = None) -> Pipeline:
        if id in self.nodes:
            raise PipelineInvalid(f"node {id!r} exists")
        if parallelism < 1:
            raise PipelineInvalid("parallelism starts at 1")
        self.nodes[id] = Node(id, block, tuple(depends_on), map_over, parallelism, resources or {})
        self._tips = (id,)
        return self

    def then(self, block: Block, id: str | None = None, **options) -> Pipeline:
        """Append behind the last node, or behind those that ``join`` named."""
        base = name = id or block.name
        k = 2
        while name in self.nodes:
            name, k = f"{base}_{k}", k + 1
        return self.add(name, block, self._tips, **options)

    def join(self, *ids: str) -> Pipeline:
        unknown = sorted(set(ids) - set(self.nodes))
        if unknown or not ids:
            raise PipelineInvalid(f"cannot join unknown nodes {unknown}")
        self._tips = ids
        return self

    def order(self) -> list[Node]:
        """Nodes behind their dependencies, otherwise in the order they were added."""
        waiting = {n.id: set(n.depends_on) for n in self.nodes.values()}
        unknown = sorted({d for ds in waiting.values() for d in ds} - set(self.nodes))
        if unknown:
            raise PipelineInvalid(f"unknown dependencies {unknown}")
        ready, out = deque(i for i, ds in waiting.items() if not ds), []
        while ready:
            done = ready.popleft()
            out.append(self.nodes[done])
            for i, ds in waiting.items():
                if done in ds:
                    ds.discard(done)
                    if not ds:
                        ready.append(i)
        if len(out) < len(self.nodes):
            raise PipelineInvalid(f"cycle among {sorted(set(self.nodes) - {n.id for n in out})}")
        return out

    def validate(self) -> list[Node]:
        """The order of execution, once ports, mapped fields and streams are in order."""
        if not self.nodes:
            raise PipelineInvalid("the pipeline is empty")
        order = self.order()
        for n in order:
            b = n.block
            if b.pattern not in PATTERNS:
                raise PipelineInvalid(f"{n.id}: unknown pattern {b.pattern!r}")
            if b.pattern == "stream" and not (b.trigger and b.checkpoint):
                raise PipelineInvalid(f"{n.id}: a stream needs a trigger and a checkpoint location")
            if n.map_over is not None:
                if n.map_over not in b.inputs.names or not isinstance(b.inputs[n.map_over].dataType, T.ArrayType):
                    raise PipelineInvalid(f"{n.id}: {n.map_over!r} is no list of its input")
                flat = [f.name for f in b.outputs if not isinstance(f.dataType, T.ArrayType)]
                if flat:
                    raise PipelineInvalid(f"{n.id}: outputs of a mapped block must be lists, {flat} are not")
            ups = [self.nodes[d].block.outputs for d in n.depends_on]
            if len(ups) == 1 and (wrong := problems(ups[0], b.inputs)):
                raise PortMismatch(f"{n.id}: {'; '.join(wrong)}")
            if len(ups) > 1:
                if twice := repeated(f.name for s in ups for f in s):
                    raise PortMismatch(f"{n.id}: several inputs offer {twice}")
                if gone := missing_fields(ups, b.inputs):
                    raise PortMismatch(f"{n.id}: no input offers {gone}")
        return order

    def describe(self) -> dict:
        nodes = [
            {
                "id": n.id, "block": n.block.name, "version": n.block.version, "code": n.block.code, "depends_on": list(n.depends_on), "map_over": n.map_over,
                "parallelism": n.parallelism, "inputs": n.block.inputs.jsonValue(), "outputs": n.block.outputs.jsonValue(), "resources": dict(n.resources),
            }
            for n in self.order()
        ]
        return {"name": self.name, "version": self.version, "nodes": nodes}

    def fingerprint(self) -> str:
        return fingerprint(self.describe())

    def inputs_of(self, node: Node, outputs: Mapping[str, DataFrame], initial: DataFrame) -> DataFrame:
        """What a node reads: the initial table, its one input, or its inputs joined by run."""
        if not node.depends_on:
            return initial
        df = outputs[node.depends_on[0]]
        for other in node.depends_on[1:]:
            df = df.join(outputs[other], "run_id")
        return df

    def apply(self, node: Node, df: DataFrame, context=None) -> DataFrame:
        """One block over all runs; a mapped block over all items of all runs, put back in order."""
        names = [f.name for f in node.block.inputs if f.name in df.columns]
        if node.map_over is None:
            out = self.evaluated(node, df.select("run_id", *names), context)
            return strict(out, T.StructType([T.StructField("run_id", df.schema["run_id"].dataType), *node.block.outputs]))
        return self.gathered(node, df, self.evaluated(node, self.items(node, df), context))

    def evaluated(self, node: Node, df: DataFrame, context=None) -> DataFrame:
        """A node's block over ``df``; its context has the profile of the node's resources, which the block hands to Spark."""
        profile = resources.profile(df.sparkSession, node.resources)
        if profile is None:
            return node.block(df, context)
        if not node.block.takes_context:
            raise ResourceError(f"{node.id}: a block with resources takes a context, for its profile")
        return node.block(df, replace(context or Context(), profile=profile))

    def items(self, node: Node, df: DataFrame) -> DataFrame:
        """The rows that a mapped block sees: one per item, with its ``partition_id``."""
        names = [f.name for f in node.block.inputs if f.name in df.columns]
        return reductions.fan_out(df.select("run_id", *names), node.map_over, node.parallelism if node.parallelism > 1 else None)

    def gathered(self, node: Node, df: DataFrame, out: DataFrame) -> DataFrame:
        """A mapped block's results, put back in order for each run of ``df``."""
        merged = reductions.fan_in(out, ["run_id"], "partition_id", lists=node.block.outputs.names)
        # runs with an empty list have no item: every list of theirs is empty
        whole = df.select("run_id").join(merged, "run_id", "left")
        empty = [F.coalesce(f.name, F.array().cast(f.dataType)).alias(f.name) for f in node.block.outputs]
        return whole.select("run_id", *empty)

    def run(self, initial: DataFrame, context=None) -> dict[str, DataFrame]:
        """Outputs of every node, lazily; nothing runs until one of them is read."""
        outputs: dict[str, DataFrame] = {}
        for node in self.validate():
            outputs[node.id] = self.apply(node, self.inputs_of(node, outputs, initial), context)
        return outputs


def python_block(name: str, function: Callable, inputs: str, outputs: str, **options) -> Block:
    """A block of a function from pandas frames to pandas frames, on the workers, with the resources of its node.

    The frames have ``run_id`` (and ``partition_id`` where the block is mapped) besides the ports.
    """

    def run(df: DataFrame, context=None) -> DataFrame:
        keys = [df.schema[c] for c in ("run_id", "partition_id") if c in df.columns]
        return df.mapInPandas(function, T.StructType([*keys, *schema(outputs)]), profile=getattr(context, "profile", None))

    return Block(name, run, schema(inputs), schema(outputs), **options)


def constant(values: Sequence[float]) -> Block:
    return Block("constant", lambda df: df.select("run_id", F.array(*(F.lit(float(v)) for v in values)).alias("values")), T.StructType([]), schema("values array<double>"))


def scale(factor: float = 1.0) -> Block:
    return Block("scale", lambda df: df.withColumn("values", reductions.scaled(F.col("values"), factor)), schema("values array<double> not null"), schema("values array<double>"))


def mean() -> Block:
    return Block("mean", lambda df: df.select("run_id", reductions.mean_or_zero(F.col("values")).alias("value")), schema("values array<double> not null"), schema("value double"))
