"""Training of sequence classifiers over the cluster: minibatch gradients, Adam, recorded metrics, pruning.

An epoch is one barrier stage, whose tasks go through the minibatches together. The rows of a minibatch
are dealt in turn to ``part``, so that no task waits for one with more rows; each part gives one partial
gradient for each net, and these are added up by a tree of sixteens, in the order of the parts, so that a
rerun gives equal numbers, whatever the number of tasks. Each net is added up and stepped in one of the
tasks, which sends its weights to the others. What meets between the tasks and in the driver has the size
of the nets alone: gradients, and a vector of weights and two moments for each. Where executors come and
go (dynamic allocation) there are no barrier stages, and a step is one job.

Several nets train side by side on the same batches. What an epoch ends with is written below a folder:
``metrics`` gets a row for each net, ``states`` the vectors. A fit that finds a folder of its own goes
on after the last epoch recorded there.
"""

from __future__ import annotations

import contextlib
import os
import pickle
import secrets
import socket
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from multiprocessing.connection import Client, Connection, Listener

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.operators import dataset, network
from kelpline.operators.network import Net
from kelpline.sources.sinks import scratch

#: Partial sums that meet in one task.
BRANCH = 16
#: Rows that are scored at a time.
BLOCK = 256
METRICS = "trial int, epoch int, train_loss double, val_loss double, accuracy double, n_train long, n_val long"
STATES = "trial int, epoch int, steps long, weights array<double>, first array<double>, second array<double>"


def arrays(table: pa.Table) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Keys, labels and values of rows, in the order of their keys."""
    table = table.sort_by("id")
    flat = table.column("features").combine_chunks().flatten().to_numpy()
    return table.column("id").to_pylist(), table.column("label").to_numpy(), flat.reshape(table.num_rows, -1)


def dropper(keys: list[int], seed: int, step: int, rate: float, drawn: dict[tuple[str, int], np.ndarray] | None = None) -> Callable[[str, int], np.ndarray]:
    """Factors of dropout for rows; they depend on key, seed and step, not on which rows meet in a task. ``drawn`` keeps the draws for other nets."""
    drawn = {} if drawn is None else drawn

    def drops(name: str, n: int) -> np.ndarray:
        if (name, n) not in drawn:
            place = sum(map(ord, name))
            drawn[name, n] = np.stack([np.random.default_rng([seed, step, place, k & 0xFFFFFFFF]).random(n) for k in keys])
        return (drawn[name, n] >= rate) / (1 - rate)

    return drops


def alike(nets: dict[int, Net]) -> list[list[int]]:
    """Numbers of nets that run side by side."""
    found: dict[tuple, list[int]] = {}
    for trial, net in nets.items():
        found.setdefault(net.alike(), []).append(trial)
    return list(found.values())


def partial_gradients(nets: dict[int, Net], vectors: dict[int, np.ndarray], tables: list[pa.Table], seed: int, step: int) -> list[list[tuple[int, int, float, np.ndarray]]]:
    """For each table, of each net: its number, rows, summed loss and summed gradient. What has equally many rows runs side by side."""
    held, found = [(*arrays(table), {}) for table in tables], {}
    for some in alike(nets):
        for n in {table.num_rows for table in tables}:
            units = [(k, t) for k, (keys, *_) in enumerate(held) if len(keys) == n for t in some]
            drops = [dropper(held[k][0], seed, step, nets[t].dropout, held[k][3]) for k, t in units]
            logits, back = network.together([nets[t] for _, t in units], [vectors[t] for _, t in units], [held[k][2] for k, _ in units], drops)
            loss, d = network.losses(logits, np.stack([held[k][1] for k, _ in units]))
            found |= {unit: (unit[1], n, float(own.sum()), g) for unit, own, g in zip(units, np.ascontiguousarray(loss), back(d))}
    return [[found[k, t] for t in nets] for k in range(len(tables))]


def gradients(batch: DataFrame, nets: dict[int, Net], vectors: dict[int, np.ndarray], seed: int, step: int, parts: int) -> dict[int, tuple[int, float, np.ndarray]]:
    """Of each net: rows of ``batch`` (id, label, features, part), summed loss and summed gradient."""
    held = batch.sparkSession.sparkContext.broadcast(vectors)

    def partial(table: pa.Table) -> pa.Table:
        part = int(table.column("part")[0].as_py())
        return as_table([(trial, part, *rest) for trial, *rest in partial_gradients(nets, held.value, [table], seed, step)[0]])

    schema = "trial int, part long, n long, loss double, gradient array<double>"
    sums = batch.select("id", "label", "features", "part").groupBy("part").applyInArrow(partial, schema)
    found = {r[0]: (r[2], r[3], np.array(r[4])) for r in merged(sums, schema, parts)}
    held.destroy()
    return found


def as_table(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64()))
    return pa.table({n: pa.array(c, k) for n, c, k in zip(("trial", "part", "n", "loss", "gradient"), map(list, zip(*rows)), kinds)})


def merged(sums: DataFrame, schema: str, parts: int) -> list:
    """Partial sums of each trial added up, BRANCH of them in a task, until one is left."""

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("part").drop(["branch"])
        total = np.zeros(len(table.column("gradient")[0].as_py()))
        for g in table.column("gradient"):
            total += g.values.to_numpy()
        return as_table([(table.column("trial")[0].as_py(), table.column("part")[0].as_py() // BRANCH, sum(table.column("n").to_pylist()), sum(table.column("loss").to_pylist()), total)])

    while parts > 1:
        sums = sums.withColumn("branch", F.floor(F.col("part") / BRANCH)).groupBy("trial", "branch").applyInArrow(add, schema)
        parts = -(-parts // BRANCH)
    return sums.collect()


def added(partial: dict[int, np.ndarray], parts: int) -> np.ndarray:
    """The sum that ``merged`` makes, of one vector for each part that has any."""
    while parts > 1:
        above: dict[int, np.ndarray] = {}
        for part in sorted(partial):
            above[part // BRANCH] = above.get(part // BRANCH, 0.0) + partial[part]
        partial, parts = above, -(-parts // BRANCH)
    return partial[0]


def undelayed(link: Connection) -> Connection:
    """``link`` without Nagle's rule, by which the end of a message waits for word that its beginning came, 40 ms often."""
    with socket.socket(fileno=os.dup(link.fileno())) as same:
        same.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
    return link


class Circle:
    """Tasks of a barrier stage, ``size`` that follow each other or all. The first ``owners`` add up what all of them bring to a step, each for nets of its own, and are connected to every other one."""

    def __init__(self, key: bytes, owners: int, size: int = 0) -> None:
        context = BarrierTaskContext.get()
        infos, place, self.held = context.getTaskInfos(), context.partitionId(), contextlib.ExitStack()
        self.tasks, self.links = size or len(infos), {}
        self.rank, self.owners = place % self.tasks, min(owners, self.tasks)
        host = infos[place].address.rsplit(":", 1)[0].strip("[]")
        with contextlib.ExitStack() as opened:
            listener = opened.enter_context(Listener((host, 0), backlog=self.tasks, authkey=key)) if self.rank < self.owners else None
            addresses = context.allGather(f"{host}:{listener.address[1]}" if listener else "")[place - self.rank :]
            for other in range(min(self.rank, self.owners)):
                name, port = addresses[other].rsplit(":", 1)
                self.links[other] = self.held.enter_context(undelayed(Client((name, int(port)), authkey=key)))
                self.links[other].send(self.rank)
            for _ in range(self.tasks - 1 - self.rank if listener else 0):
                link = self.held.enter_context(undelayed(listener.accept()))
                self.links[link.recv()] = link
        self.sender = self.held.enter_context(ThreadPoolExecutor(1))

    def __enter__(self) -> Circle:
        return self

    def __exit__(self, *error) -> None:
        self.held.close()

    def share(self, trials: list[int], owner: int) -> list[int]:
        """The nets of an owner."""
        return trials[owner :: self.owners] if owner < self.owners else []

    def traded(self, given: dict[int, bytes], wanted: range) -> dict[int, bytes]:
        """What the tasks ``wanted`` give this one, which gives ``given`` to others; with its own.

        A thread sends while this one receives, so none waits for one that waits for it.
        """

        def send() -> None:
            for k in range(1, self.tasks):
                other = (self.rank + k) % self.tasks
                if other in given:
                    self.links[other].send_bytes(given[other])

        sent = self.sender.submit(send) if given.keys() - {self.rank} else None
        found = {other: given[other] if other == self.rank else self.links[other].recv_bytes() for other in wanted}
        if sent:
            sent.result()
        return found


def grid(slots: int, parts: int, nets: int) -> tuple[int, int]:
    """Into how many groups the nets go, and how many tasks share the rows of a group: more than one where that takes a quarter from the largest task. No task has all rows where two can share them."""
    ways = [(-(-nets // g) * -(-parts // r), g, r) for g in range(1, nets + 1) for r in [min(parts, slots // g)] if r >= min(2, parts, slots)]
    return (min(ways) if 4 * min(ways)[0] <= 3 * ways[0][0] else ways[0])[1:]


def grouped(nets: dict[int, Net], groups: int) -> list[list[int]]:
    """Numbers of nets in groups of about equal size, none empty."""
    found: list[list[int]] = [[] for _ in range(groups)]
    for trial in sorted(nets, key=lambda t: (-nets[t].size(), t)):
        min(found, key=lambda g: sum(nets[t].size() for t in g)).append(trial)
    return found


def runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, pa.Table]]:
    """Rows that follow each other with one value of ``column``, and the value."""
    held = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        held = now if held is None else pa.concat_tables([held, now])
        values = held.column(column).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist()]
        for low, high in zip(cuts, cuts[1:]):
            yield int(values[low]), held.slice(low, high - low)
        held = held.slice(cuts[-1])
    if held is not None and held.num_rows:
        yield int(held.column(column)[0].as_py()), held


class Adam:
    """Weights with their first and second moments."""

    def __init__(self, weights: np.ndarray, rate: float) -> None:
        self.weights, self.rate, self.steps = weights, rate, 0
        self.first, self.second = np.zeros_like(weights), np.zeros_like(weights)

    def step(self, g: np.ndarray, decay: float = 0.9, decay_second: float = 0.999, eps: float = 1e-8) -> None:
        self.steps += 1
        self.first = decay * self.first + (1 - decay) * g
        self.second = decay_second * self.second + (1 - decay_second) * g * g
        bent = self.first / (1 - decay**self.steps), self.second / (1 - decay_second**self.steps)
        self.weights = self.weights - self.rate * bent[0] / (np.sqrt(bent[1]) + eps)


def tasks_at_once(spark: SparkSession) -> int:
    """How many tasks a barrier stage may have; 0 where there can be none."""
    if spark.conf.get("spark.dynamicAllocation.enabled", "false").lower() == "true":
        return 0
    context = spark.sparkContext._jsc.sc()
    return context.maxNumConcurrentTasks(context.resourceProfileManager().defaultResourceProfile())


def epoch_steps(shuffled: DataFrame, nets: dict[int, Net], adams: dict[int, Adam], seed: int, first: int, n_batches: int, parts: int) -> dict[int, tuple[Adam, float]]:
    """Of each net the state after all steps over ``shuffled`` (id, label, features, part, batch_id), and the summed loss; the first step has number ``first``.

    A barrier stage: each task has some of the parts, ordered by batch, for a group of the nets, and keeps the rows of a step.
    """
    spark = shuffled.sparkSession
    slots = tasks_at_once(spark)
    if not slots:
        total = dict.fromkeys(nets, 0.0)
        path = scratch(spark, "batches")
        shuffled.repartitionByRange("batch_id").sortWithinPartitions("batch_id").write.parquet(path)
        for k in range(n_batches):
            batch = spark.read.parquet(path).filter(F.col("batch_id") == k)
            for t, (n, loss, g) in gradients(batch, nets, {t: adams[t].weights for t in nets}, seed, first + k, parts).items():
                adams[t].step(g / n)
                total[t] += loss
        return {t: (adams[t], total[t]) for t in nets}
    held, key = spark.sparkContext.broadcast({t: adams[t] for t in nets}), secrets.token_bytes(16)
    many, size = grid(slots, parts, len(nets))
    groups = grouped(nets, many)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trials = groups[BarrierTaskContext.get().partitionId() // size]
        steps, some, vectors = runs(batches, "batch_id"), {t: nets[t] for t in trials}, {t: held.value[t].weights for t in trials}
        now, rows = next(steps, (n_batches, None))
        with Circle(key, len(trials), size) as circle:
            shares = [circle.share(trials, task) for task in range(size)]
            own, total = {t: held.value[t] for t in shares[circle.rank]}, dict.fromkeys(shares[circle.rank], 0.0)
            everyone, owners = range(size), range(circle.owners)
            for k in range(n_batches):
                partial: list[dict[int, np.ndarray]] = [{} for _ in owners]
                if now == k:
                    mine = list(runs(rows.combine_chunks().to_batches(), "part"))
                    for (part, table), sums in zip(mine, partial_gradients(some, vectors, [table for _, table in mine], seed, first + k)):
                        found = {t: np.concatenate([[loss], g]) for t, _, loss, g in sums}
                        for owner in owners:
                            partial[owner][part] = np.concatenate([[table.num_rows], *(found[t] for t in shares[owner])])
                    now, rows = next(steps, (n_batches, None))
                brought = circle.traded({o: pickle.dumps(p) for o, p in enumerate(partial)}, everyone if own else range(0))
                if own:
                    n, *sums = np.split(added({p: v for each in brought.values() for p, v in pickle.loads(each).items()}, parts), np.cumsum([1, *(1 + len(vectors[t]) for t in own)])[:-1])
                    for t, s in zip(own, sums):
                        own[t].step(s[1:] / n[0])
                        total[t] += float(s[0])
                stepped = pickle.dumps({t: a.weights for t, a in own.items()})
                for each in circle.traded(dict.fromkeys(everyone, stepped) if own else {}, owners).values():
                    vectors |= pickle.loads(each)
        if own:
            yield pa.RecordBatch.from_pylist([{"trial": t, "steps": a.steps, "weights": a.weights, "first": a.first, "second": a.second, "loss": total[t]} for t, a in own.items()], out)

    lists = pa.list_(pa.float64())
    out = pa.schema([("trial", pa.int32()), ("steps", pa.int64()), ("weights", lists), ("first", lists), ("second", lists), ("loss", pa.float64())])
    dealt = shuffled.select("id", "label", "features", "part", "batch_id", F.explode(F.array(*((F.pmod("part", F.lit(size)) + g * size).cast("int") for g in range(many)))).alias("task"))
    dealt = dealt.repartitionById(many * size, "task").sortWithinPartitions("batch_id", "part")
    found = {}
    for r in dealt.mapInArrow(run, "trial int, steps long, weights array<double>, first array<double>, second array<double>, loss double", barrier=True).collect():
        state = Adam(np.array(r["weights"]), nets[r["trial"]].rate)
        state.first, state.second, state.steps = np.array(r["first"]), np.array(r["second"]), r["steps"]
        found[r["trial"]] = state, r["loss"]
    held.destroy()
    return found


def scored(rows: DataFrame, nets: dict[int, Net], vectors: dict[int, np.ndarray]) -> DataFrame:
    """trial, id, label, pred and loss for each row (id, label, features) and net. A net's label is the first of the largest."""
    held = rows.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                keys, labels, x = arrays(pa.Table.from_batches([batch.slice(low, BLOCK)]))
                for some in alike(nets):
                    logits, _ = network.together([nets[t] for t in some], [held.value[t] for t in some], [x] * len(some))
                    for trial, pred, loss in zip(some, logits.argmax(axis=2), network.losses(logits, labels)[0]):
                        yield pa.RecordBatch.from_arrays([pa.array([trial] * len(keys), pa.int32()), pa.array(keys), pa.array(labels), pa.array(pred, pa.int32()), pa.array(loss)], ["trial", "id", "label", "pred", "loss"])

    return rows.select(F.col("id").cast("long"), F.col("label").cast("int"), "features").mapInArrow(run, "trial int, id long, label int, pred int, loss double")


def metrics(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(METRICS).parquet(f"{folder}/metrics")


def states(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(STATES).parquet(f"{folder}/states")


def exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def load(spark: SparkSession, folder: str, trial: int, epoch: int, rate: float = 0.0) -> Adam:
    """The recorded state of a net at the end of an epoch."""
    row = states(spark, folder).filter((F.col("trial") == trial) & (F.col("epoch") == epoch)).first()
    held = Adam(np.array(row["weights"]), rate)
    held.first, held.second, held.steps = np.array(row["first"]), np.array(row["second"]), row["steps"]
    return held


def fit(train: DataFrame, val: DataFrame, nets: dict[int, Net], epochs: int, batch: int, folder: str, seed: int = 0, parts: int = 64, stop: Callable[[DataFrame], list[int]] | None = None) -> DataFrame:
    """Train ``nets`` side by side and record every epoch below ``folder``; gives the metrics recorded there.

    ``train`` and ``val`` have id (long), label (from 0) and features (arrays as long as the nets are
    wide); rows with a null among these are left out. Batches are shuffled anew each epoch by hash, the
    last is shorter. ``stop`` is asked after each epoch, with all that is recorded, for nets to end.
    """
    spark = train.sparkSession
    fine = F.col("id").isNotNull() & F.col("label").isNotNull() & ~F.coalesce(F.exists("features", lambda v: v.isNull()), F.lit(True))
    own = [F.col("id").cast("long").alias("id"), F.col("label").cast("int").alias("label"), F.col("features").cast("array<double>").alias("features")]
    held = [scratch(spark, "rows") for _ in range(2)]
    for rows, path in zip((train, val), held):
        rows.filter(fine).select(*own).repartition(spark.sparkContext.defaultParallelism, "id").write.parquet(path)
    train, val = (spark.read.parquet(path) for path in held)
    n_train, n_val = train.count(), val.count()
    n_batches = -(-n_train // batch)
    alive, done = dict(nets), {}
    adams = {trial: Adam(net.drawn(seed + trial), net.rate) for trial, net in nets.items()}
    if exists(spark, f"{folder}/metrics"):
        # An epoch's metrics are written last, so its state is there too.
        for trial, epoch in metrics(spark, folder).groupBy("trial").agg(F.max("epoch")).collect():
            if trial in nets:
                done[trial], adams[trial] = epoch, load(spark, folder, trial, epoch, nets[trial].rate)
        for trial in stop(metrics(spark, folder)) if stop else ():
            alive.pop(trial, None)
    for epoch in range(1, epochs + 1):
        now = {t: net for t, net in alive.items() if done.get(t, 0) < epoch}
        if not now or not n_train:
            continue
        shuffled, total = dataset.batches(train, "id", batch, seed * 1000 + epoch, parts), {}
        for t, (state, loss) in epoch_steps(shuffled, now, adams, seed, epoch * n_batches, n_batches, parts).items():
            adams[t], total[t] = state, loss
        each = scored(val, now, {t: adams[t].weights for t in now}).groupBy("trial").agg(F.sum("loss").alias("loss"), F.sum((F.col("pred") == F.col("label")).cast("int")).alias("hits")).collect()
        seen = {r["trial"]: r for r in each}
        rows = [(t, epoch, total[t] / n_train, seen[t]["loss"] / n_val if n_val else None, seen[t]["hits"] / n_val if n_val else None, n_train, n_val) for t in now]
        spark.createDataFrame([(t, epoch, a.steps, a.weights.tolist(), a.first.tolist(), a.second.tolist()) for t, a in adams.items() if t in now], STATES).write.mode("append").parquet(f"{folder}/states")
        spark.createDataFrame(rows, METRICS).write.mode("append").parquet(f"{folder}/metrics")
        for trial in stop(metrics(spark, folder)) if stop else ():
            alive.pop(trial, None)
    return metrics(spark, folder) if n_train else spark.createDataFrame([], METRICS)
