"""Queries for training and evaluation: features, splits, forward arithmetic, schedules, metrics, chat."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.functions import columns as C
from kelpline.operators import chat, dataset, learn, metrics, normalize, training
from kelpline.operators.network import Net
from kelpline.plans import schedules, search
from kelpline.sources.sinks import recorded, scratch
from kelpline.sources.tables import features, table

BATCH = 16


def scored(spark: SparkSession, d: str) -> DataFrame:
    """The first ten features as logits of the ten labels."""
    return features(spark, d).withColumn("logits", F.slice("features", 1, 10)).withColumn("pred", C.argmax(F.col("logits"))).withColumn("loss", C.cross_entropy(F.col("logits"), F.col("label")))


def scores(spark: SparkSession, d: str) -> DataFrame:
    """A metric table of 20 trials of 20 epochs, from seeded draws."""
    grid = spark.range(20).select(F.col("id").alias("trial")).withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(20))))
    return grid.withColumn("accuracy", F.round(C.uniform("score", F.col("trial"), F.col("epoch")), 6))


def zscore_features(spark, d):
    return normalize.zscore(features(spark, d)).select("id", F.posexplode("features").alias("place", "x")).select("id", "place", F.round("x", 6).alias("x"))


def zscore_train_fit(spark, d):
    rows = dataset.split_hash(features(spark, d), "id")
    return normalize.zscore(rows, rows.filter("split = 'train'")).select("id", "split", F.posexplode("features").alias("place", "x")).withColumn("x", F.round("x", 6))


def pixel_normalize(spark, d):
    """Event values as bytes of three channels, standardised per channel."""
    rows = table(spark, d, "events").select("event_id", C.quantize_u8(F.col("value")).alias("u"), F.pmod("event_id", F.lit(3)).cast("int").alias("channel"))
    out = normalize.standardise_pixels(F.col("u"), F.col("channel"), [0.485, 0.456, 0.406], [0.229, 0.224, 0.225])
    return rows.select("event_id", "channel", F.round(out, 6).alias("x"))


def layer_norm(spark, d):
    rows = features(spark, d).select("id", F.posexplode(normalize.layer_norm(F.col("features"))).alias("place", "x"))
    return rows.select("id", "place", F.round("x", 5).alias("x"))


def split_exact(spark, d):
    return dataset.split_exact(features(spark, d).select("id"), "id", F.floor(F.col("n") * 4 / 5.0))


def split_validation(spark, d):
    """A fifth, rounded up, is held out."""
    return dataset.split_exact(features(spark, d).select("id"), "id", F.col("n") - F.ceil(F.col("n") / 5.0), seed=1)


def split_hash(spark, d):
    return dataset.split_hash(features(spark, d).select("id"), "id")


def shuffle_order(spark, d):
    return dataset.ranked(table(spark, d, "events").select("event_id"), "event_id", seed=3)


def batch_assign(spark, d):
    batched = dataset.batches(features(spark, d).select("id"), "id", BATCH)
    n = batched.agg((F.max("batch_id") + 1).alias("n_batches"))
    return batched.crossJoin(F.broadcast(n))


def linear_layer(spark, d):
    """Three outputs with fixed weights."""
    row = lambda o: F.transform(F.sequence(F.lit(0), F.size("features") - 1), lambda i: F.pmod(i * (o + 3), F.lit(7)) / 10.0 - 0.3)
    return features(spark, d).select("id", *(F.round(C.dot(F.col("features"), row(o)) + 0.1 * o, 6).alias(f"y{o}") for o in range(3)))


def gelu_tanh(spark, d):
    return table(spark, d, "events").select("event_id", F.round(C.gelu_tanh(F.col("value") / 50.0 - 1), 6).alias("y"))


def gelu_exact(spark, d):
    return table(spark, d, "events").select("event_id", F.round(C.gelu(F.col("value") / 50.0 - 1), 6).alias("y"))


def normal_weights(spark, d, deviation: float = 0.02):
    """Truncated normal weights of a layer from the features to the labels, drawn by place and label."""
    rows = table(spark, d, "embeddings").select("label", F.explode(F.sequence(F.lit(0), F.size("embedding") - 1)).alias("place")).distinct()
    w = C.truncated_normal(C.uniform("init", F.col("place"), F.col("label")), 0.0, deviation)
    return rows.select("place", "label", F.round(w, 8).alias("w"))


def dropout_mask(spark, d, rate: float = 0.3):
    keep = C.uniform("drop", F.col("event_id")) >= rate
    return table(spark, d, "events").select("event_id", F.round(F.when(keep, F.col("value") / (1 - rate)).otherwise(0.0), 6).alias("y"))


def stochastic_depth(spark, d, rate: float = 0.2, mode: str = "row"):
    """Whole series (mode row) or all of them (mode batch) survive, scaled, or are zero."""
    if not 0 <= rate <= 1 or mode not in ("row", "batch"):
        raise ValueError("rate lies in 0..1 and mode is row or batch")
    keep = C.uniform("depth", F.col("user_id") if mode == "row" else "all") >= rate
    scaled = F.lit(0.0) if rate == 1 else F.col("value") / (1 - rate)
    return table(spark, d, "events").select("event_id", F.round(F.when(keep, scaled).otherwise(0.0), 6).alias("y"))


def flatten_matrix(spark, d):
    """Each feature vector cut into rows of 8, the last as long as it comes, and flattened again."""
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("features") - 1) / 8.0).cast("int")), lambda i: F.slice("features", i * 8 + 1, 8))
    rows = features(spark, d).withColumn("m", F.when(F.size("features") > 0, cut))
    flat = F.flatten("m")
    return rows.select("id", F.size(flat).alias("n"), F.posexplode(flat).alias("place", "x")).withColumn("x", F.round("x", 6))


def letterbox_geometry(spark, d):
    sizes = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 17 + 3).alias("width"), (F.pmod("p_partkey", F.lit(900)) + 1).cast("int").alias("height"))
    return sizes.select("p_partkey", *schedules.letterbox(F.col("width"), F.col("height")))


def sd_schedule(spark, d):
    return schedules.drop_rates(spark).withColumn("rate", F.round("rate", 6))


def lr_schedule(spark, d):
    return schedules.learning_rates(spark).withColumn("lr", F.round("lr", 9))


def search_space(spark, d):
    space = schedules.search_space(spark)
    return space.select("trial", "layers", "filters", F.round("dropout", 6).alias("dropout"), F.round("lr", 8).alias("lr"))


def prune_median(spark, d):
    return schedules.pruned(scores(spark, d)).select("trial", "epoch", F.round("best", 6).alias("best"), "judged", "prune")


def best_trial(spark, d):
    return schedules.best_trial(scores(spark, d))


def train_classifier(spark, d):
    """Held-out predictions of a logistic regression on z-scored features."""
    rows = dataset.split_hash(normalize.zscore(features(spark, d)), "id")
    model = learn.train(rows.filter("split = 'train'"))
    return learn.predict(model, rows.filter("split = 'test'"))


def train_perceptron(spark, d):
    """Held-out predictions of a perceptron with a hidden layer, written as a checkpoint and read again."""
    rows = dataset.split_hash(normalize.zscore(features(spark, d)), "id")
    path = scratch(spark, "checkpoint")
    learn.save(learn.train(rows.filter("split = 'train'"), hidden=16), path)
    return learn.predict(learn.load(path), rows.filter("split = 'test'"))


def tune_classifier(spark, d):
    found = learn.tune(features(spark, d).select("label", "features"))
    return spark.createDataFrame([(float(r), float(a)) for r, a in found], "reg double, accuracy double")


def parts_of(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Scaled features by their training rows, a fifth, rounded up, held out."""
    rows = features(spark, d)
    split = dataset.split_exact(rows.select("id"), "id", F.col("n") - F.ceil(F.col("n") / 5.0), seed=1)
    held = rows.join(split, "id")
    scaled = normalize.zscore(held, held.filter("split = 'train'"))
    return scaled.filter("split = 'train'"), scaled.filter("split = 'test'")


def small_net(spark: SparkSession, d: str, **settings) -> Net:
    """A net for the features at a size that a few cores train; the widths and classes are those of the table."""
    width, classes = features(spark, d).agg(F.max(F.size("features")), F.max("label") + 1).first()
    return Net(width, classes, **{"filters": 8, "hidden": 16, "dense": 32} | settings)


def net_record(spark: SparkSession, d: str) -> str:
    net = small_net(spark, d, rate=0.005)
    return recorded(spark, d, "fit", lambda folder: training.fit(*parts_of(spark, d), {0: net}, 4, 128, folder, parts=8))


def train_network(spark, d):
    """Losses and accuracy of a net of convolutions, a two-way LSTM and attention, by epoch."""
    return training.metrics(spark, net_record(spark, d)).select("trial", "epoch", *(F.round(c, 6).alias(c) for c in ("train_loss", "val_loss", "accuracy")), "n_train", "n_val")


def reload_network(spark, d):
    """Held-out predictions of the trained net, read again from its record."""
    folder = net_record(spark, d)
    state = training.load(spark, folder, 0, 4)
    return training.scored(parts_of(spark, d)[1], {0: small_net(spark, d)}, {0: state.weights}).select("id", "label", "pred", F.round("loss", 6).alias("loss"))


def search_record(spark: SparkSession, d: str) -> str:
    def make(folder: str) -> None:
        base = small_net(spark, d, hidden=8, dense=16)
        net = lambda x: replace(base, filters=int(x["filters"]), layers=int(x["layers"]), dropout=x["dropout"], rate=x["rate"])
        search.search(*parts_of(spark, d), net, folder, filters=(4, 12), trials=20, side_by_side=10, epochs=3, parts=8)

    return recorded(spark, d, "search", make)


def search_trials(spark, d):
    """Twenty trials of a search: their settings, how far they came and what they reached."""
    folder = search_record(spark, d)
    wide = spark.read.parquet(f"{folder}/settings").groupBy("trial").pivot("name", ["layers", "filters", "dropout", "rate"]).agg(F.first("value"))
    rows = search.judged(training.metrics(spark, folder), 3).join(wide, "trial")
    return rows.select("trial", F.col("layers").cast("int").alias("layers"), F.col("filters").cast("int").alias("filters"), F.round("dropout", 6).alias("dropout"), F.round(F.exp("rate"), 8).alias("lr"), "epochs", "stopped", F.round("accuracy", 6).alias("accuracy"))


def search_pruning(spark, d):
    """Every recorded epoch of the search with the trial's best so far and whether it ended there."""
    rows = training.metrics(spark, search_record(spark, d))
    return schedules.pruned(rows.select("trial", "epoch", "accuracy")).select("trial", "epoch", F.round("best", 6).alias("best"), "judged", "prune")


def search_best(spark, d):
    """The trial and epoch with the highest recorded accuracy."""
    return schedules.best_trial(training.metrics(spark, search_record(spark, d)).select("trial", "epoch", "accuracy"))


def argmax(spark, d):
    return scored(spark, d).select("id", "label", "pred")


def accuracy(spark, d):
    return metrics.accuracy(scored(spark, d)).withColumn("accuracy", F.round("accuracy", 6))


def cross_entropy(spark, d):
    return scored(spark, d).select("id", F.round("loss", 6).alias("loss"))


def loss_averages(spark, d):
    rows = dataset.batches(scored(spark, d).select("id", "loss"), "id", BATCH)
    return metrics.losses(rows).select(*(F.round(c, 6).alias(c) for c in ("per_batch", "per_dataset_of_batch_means", "per_sample")))


def loss_per_batch(spark, d):
    return loss_averages(spark, d).select(F.col("per_batch").alias("loss"))


def loss_per_dataset(spark, d):
    return loss_averages(spark, d).select(F.col("per_dataset_of_batch_means").alias("loss"))


def confusion_matrix(spark, d):
    return metrics.confusion(scored(spark, d))


def confusion_documents(spark, d):
    """Length as a stand-in prediction of the quality label."""
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return metrics.confusion(rows.select(F.col("quality").alias("label"), (F.col("n_chars") > 1000).cast("int").alias("pred")))


def metric_report(spark, d):
    """A line per epoch: best accuracy of all trials so far."""
    best = scores(spark, d).groupBy("epoch").agg(F.max("accuracy").alias("top"), F.avg("accuracy").alias("mean"))
    return best.select("epoch", F.format_string("epoch %d: best %s", "epoch", F.round(F.col("top") * 100, 2).cast("decimal(6,2)").cast("string")).alias("line"), F.round("mean", 6).alias("mean"))


def log_every_k(spark, d, every: int = 5):
    """Progress after each ``every``-th batch: rows seen and their share. All batches but the last are full."""
    total = features(spark, d).agg(F.count(F.lit(1)).alias("total")).filter("total > 0")
    last = F.ceil(F.col("total") / float(BATCH)).cast("long") - 1
    logged = total.select("total", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(every).cast("long"))).alias("batch_id"))
    seen = F.least((F.col("batch_id") + 1) * BATCH, F.col("total"))
    return logged.select("batch_id", seen.alias("seen"), F.round(100 * seen / F.col("total"), 4).alias("percent"))


def chat_prompt(spark, d):
    return chat.prompts(table(spark, d, "conversations")).select("conv_id", F.md5("prompt").alias("prompt_md5"), F.length("prompt").alias("n_chars"))


def tokens(spark, d):
    """Code points of each word of a turn stand for token ids."""
    return table(spark, d, "conversations").select("conv_id", "turn", F.transform(F.split("text", " ", -1), lambda w: F.length(w)).alias("ids"))


def pad_sequences(spark, d):
    rows = chat.padded(tokens(spark, d), "ids", "conv_id", -1)
    return rows.select("conv_id", "turn", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


def trim_prefix(spark, d):
    rows = tokens(spark, d).withColumn("prompt", F.slice("ids", 1, 3))
    return rows.select("conv_id", "turn", F.array_join(chat.without_prompt(F.col("ids"), F.col("prompt")).cast("array<string>"), ",").alias("rest"))


QUERIES = {f.__name__: f for f in (zscore_features, zscore_train_fit, pixel_normalize, layer_norm, split_exact, split_validation, split_hash, shuffle_order, batch_assign, linear_layer, gelu_tanh, gelu_exact, normal_weights, dropout_mask, stochastic_depth, flatten_matrix, letterbox_geometry, sd_schedule, lr_schedule, search_space, prune_median, best_trial, train_classifier, train_perceptron, tune_classifier, train_network, reload_network, search_trials, search_pruning, search_best, argmax, accuracy, cross_entropy, loss_averages, loss_per_batch, loss_per_dataset, confusion_matrix, confusion_documents, metric_report, log_every_k, chat_prompt, pad_sequences, trim_prefix)}

E = "WITH e AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS f FROM embeddings), x AS (SELECT id, label, unnest(f) AS x, generate_subscripts(f, 1) - 1 AS place FROM e) "
DRAW = "('0x' || substr(md5({}), 1, 8))::BIGINT"
U = DRAW + " / 4294967296.0"
L = "WITH e AS (SELECT vec_id AS id, label, embedding[1:10]::DOUBLE[] AS z FROM embeddings), p AS (SELECT *, (list_position(z, list_max(z)) - 1)::INT AS pred, ln(list_sum(list_transform(z, lambda v: exp(v)))) - z[label + 1] AS loss FROM e) "
B = L + ", b AS (SELECT *, (row_number() OVER (ORDER BY md5(id || ':0'), id) - 1) // 16 AS batch_id FROM p), g AS (SELECT batch_id, avg(loss) AS mean, sum(loss) AS total, count(*) AS n FROM b GROUP BY 1) "
T = f"WITH s AS (SELECT t AS trial, e::INT AS epoch, round({U.format(chr(39) + 'score:' + chr(39) + ' || t || ' + chr(39) + ':' + chr(39) + ' || e')}, 6) AS accuracy FROM range(20) a(t), range(1, 21) b(e)) "
K = "WITH k AS (SELECT conv_id, turn, list_transform(string_split(text, ' '), lambda w: length(w)) AS ids FROM conversations) "
MODELS = """
    WITH m(model, d1, d2, d3, d4, w1, w2, w3, w4, most) AS (VALUES
        ('tiny', 3, 3, 9, 3, 96, 192, 384, 768, 0.1::DOUBLE), ('small', 3, 3, 27, 3, 96, 192, 384, 768, 0.4),
        ('base', 3, 3, 27, 3, 128, 256, 512, 1024, 0.5), ('large', 3, 3, 27, 3, 192, 384, 768, 1536, 0.5)),
    b AS (SELECT *, unnest(range(d1 + d2 + d3 + d4))::INT AS block FROM m),
    s AS (SELECT *, (block >= d1)::INT + (block >= d1 + d2)::INT + (block >= d1 + d2 + d3)::INT AS stage FROM b)
    SELECT model, block, stage, [w1, w2, w3, w4][stage + 1]::INT AS width, round(most * block / (d1 + d2 + d3 + d4 - 1), 6) AS rate FROM s"""
ORACLES = {
    "zscore_features": E + "SELECT id, place::INT AS place, round((x - avg(x) OVER p) / CASE WHEN stddev_pop(x) OVER p = 0 THEN 1 ELSE stddev_pop(x) OVER p END, 6) AS x FROM x WINDOW p AS (PARTITION BY place)",
    "zscore_train_fit": E + f", h AS (SELECT *, {DRAW.format('id::VARCHAR')} % 100 < 80 AS tr FROM x), q AS (SELECT place, avg(x) AS m, stddev_pop(x) AS d FROM h WHERE tr GROUP BY 1), z AS (SELECT id, tr, place, (x - m) / CASE WHEN d = 0 THEN 1 ELSE d END AS x FROM h JOIN q USING (place)) SELECT id, CASE WHEN tr THEN 'train' ELSE 'test' END AS split, place::INT AS place, round(x, 6) AS x FROM z",
    "pixel_normalize": "WITH u AS (SELECT event_id, (event_id % 3)::INT AS channel, round_even(greatest(0.0, least(255.0, coalesce(value, 0)))::DOUBLE, 0)::INT AS u FROM events) SELECT event_id, channel, round((u / 255.0::DOUBLE - [0.485, 0.456, 0.406][channel + 1]::DOUBLE) / [0.229, 0.224, 0.225][channel + 1]::DOUBLE, 6) AS x FROM u",
    "layer_norm": E + "SELECT id, place::INT AS place, round((x - avg(x) OVER p) / sqrt(var_pop(x) OVER p + 1e-6), 5) AS x FROM x WINDOW p AS (PARTITION BY id)",
    "split_exact": "SELECT vec_id AS id, CASE WHEN row_number() OVER (ORDER BY md5(vec_id || ':0'), vec_id) <= floor(count(*) OVER () * 4 / 5.0) THEN 'train' ELSE 'test' END AS split FROM embeddings",
    "split_validation": "SELECT vec_id AS id, CASE WHEN row_number() OVER (ORDER BY md5(vec_id || ':1'), vec_id) <= count(*) OVER () - ceil(count(*) OVER () / 5.0) THEN 'train' ELSE 'test' END AS split FROM embeddings",
    "split_hash": f"SELECT vec_id AS id, CASE WHEN {DRAW.format('vec_id::VARCHAR')} % 100 < 80 THEN 'train' ELSE 'test' END AS split FROM embeddings",
    "shuffle_order": "SELECT event_id, row_number() OVER (ORDER BY md5(event_id || ':3'), event_id) AS place FROM events",
    "batch_assign": "SELECT vec_id AS id, ((row_number() OVER (ORDER BY md5(vec_id || ':0'), vec_id) - 1) // 16)::BIGINT AS batch_id, ceil(count(*) OVER () / 16.0)::BIGINT AS n_batches FROM embeddings",
    "linear_layer": E + "SELECT id, " + ", ".join(f"round(sum(x * (place * {o + 3} % 7 / 10.0::DOUBLE - 0.3::DOUBLE)) + 0.1 * {o}, 6) AS y{o}" for o in range(3)) + " FROM x GROUP BY id",
    "gelu_tanh": "WITH v AS (SELECT event_id, value / 50.0 - 1 AS x FROM events) SELECT event_id, round(0.5 * x * (1 + tanh(sqrt(2 / pi()) * (x + 0.044715 * x * x * x))), 6) AS y FROM v",
    "gelu_exact": f"WITH v AS (SELECT event_id, value / 50.0 - 1 AS x FROM events), r AS (SELECT *, x / sqrt(2) AS z FROM v) SELECT event_id, round(0.5 * x * (1 + {C.erf_sql('z')}), 6) + 0.0 AS y FROM r",
    "normal_weights": f"""WITH k AS (SELECT DISTINCT label, unnest(range(len(embedding)))::INT AS place FROM embeddings),
        u AS (SELECT *, 2 * {U.format("'init:' || place || ':' || label")} - 1 AS y FROM k), l AS (SELECT *, ln((1 - y) * (1 + y)) AS r FROM u),
        m AS (SELECT *, 2 / (pi() * 0.147) + r / 2 AS m FROM l), x0 AS (SELECT *, sign(y) * sqrt(greatest(sqrt(m * m - r / 0.147) - m, 0)) AS x FROM m),
        {", ".join(f"e{i} AS (SELECT * EXCLUDE (q), x - q / (1 + x * q) AS z FROM (SELECT *, ({C.erf_sql('x')} - y) / (2 / sqrt(pi()) * exp(-(x * x))) AS q FROM x{i})), x{i + 1} AS (SELECT * EXCLUDE (x, z), z AS x FROM e{i})" for i in range(3))}
        SELECT place, label, round(0.02 * sqrt(2) * x, 8) + 0.0 AS w FROM x3""",
    "dropout_mask": f"SELECT event_id, round(CASE WHEN {U.format(chr(39) + 'drop:' + chr(39) + ' || event_id')} >= 0.3 THEN value / 0.7 ELSE 0 END, 6) AS y FROM events",
    "stochastic_depth": f"SELECT event_id, round(CASE WHEN {U.format(chr(39) + 'depth:' + chr(39) + ' || user_id')} >= 0.2 THEN value / 0.8 ELSE 0 END, 6) AS y FROM events",
    "flatten_matrix": E + "SELECT id, 64 AS n, place::INT AS place, round(x, 6) AS x FROM x",
    "letterbox_geometry": "WITH z AS (SELECT p_partkey, p_size * 17 + 3 AS w, (p_partkey % 900 + 1)::INT AS h FROM part), n AS (SELECT p_partkey, greatest(1, floor(w * least(224 / w, 224 / h)))::INT AS new_width, greatest(1, floor(h * least(224 / w, 224 / h)))::INT AS new_height FROM z) SELECT *, floor((224 - new_width) / 2)::INT AS \"left\", floor((224 - new_height) / 2)::INT AS top FROM n",
    "sd_schedule": MODELS,
    "lr_schedule": "SELECT i AS epoch, round(0.001::DOUBLE * pow(0.1::DOUBLE, i // 20), 9) AS lr FROM range(1, 51) r(i)",
    "search_space": "SELECT i AS trial, (1 + floor({a} * 3))::INT AS layers, (32 + floor({b} * 97))::INT AS filters, round(0.1 + 0.4 * {c}, 6) AS dropout, round(pow(10.0::DOUBLE, -5 + 4 * {d}), 8) AS lr FROM range(20) r(i)".format(**{k: U.format(f"'0:{n}:' || i") for k, n in zip("abcd", ("layers", "filters", "dropout", "lr"))}),
    "prune_median": T + ", b AS (SELECT *, max(accuracy) OVER (PARTITION BY trial ORDER BY epoch) AS best FROM s), q AS (SELECT b.trial, b.epoch, b.best, count(o.trial) AS n, quantile_cont(o.accuracy, 0.5) AS med FROM b LEFT JOIN s o ON o.epoch = b.epoch AND o.trial < b.trial GROUP BY ALL) SELECT trial, epoch, round(best, 6) AS best, n >= 5 AS judged, coalesce(n >= 5 AND best < med, false) AS prune FROM q",
    "best_trial": T + "SELECT trial, epoch, accuracy FROM s ORDER BY accuracy DESC, trial, epoch LIMIT 1",
    "argmax": L + "SELECT id, label, pred FROM p",
    "accuracy": L + "SELECT sum((pred = label)::INT)::BIGINT AS correct, count(*) AS n, round(avg((pred = label)::INT), 6) AS accuracy FROM p",
    "cross_entropy": L + "SELECT id, round(loss, 6) AS loss FROM p",
    "loss_averages": B + "SELECT round(avg(mean), 6) AS per_batch, round(sum(mean) / sum(n), 6) AS per_dataset_of_batch_means, round(sum(total) / sum(n), 6) AS per_sample FROM g",
    "loss_per_batch": B + "SELECT round(avg(mean), 6) AS loss FROM g",
    "loss_per_dataset": B + "SELECT round(sum(mean) / sum(n), 6) AS loss FROM g",
    "confusion_matrix": L + "SELECT label, pred, count(*) AS n FROM p GROUP BY ALL",
    "confusion_documents": "SELECT quality AS label, (n_chars > 1000)::INT AS pred, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL",
    "metric_report": T + "SELECT epoch, 'epoch ' || epoch || ': best ' || round(max(accuracy) * 100, 2)::DECIMAL(6, 2) AS line, round(avg(accuracy), 6) AS mean FROM s GROUP BY epoch",
    "log_every_k": "WITH b AS (SELECT (row_number() OVER (ORDER BY md5(vec_id || ':0'), vec_id) - 1) // 16 AS batch_id FROM embeddings), g AS (SELECT batch_id, count(*) AS n FROM b GROUP BY 1), r AS (SELECT batch_id, sum(n) OVER (ORDER BY batch_id) AS seen, sum(n) OVER () AS total FROM g) SELECT batch_id::BIGINT AS batch_id, seen::BIGINT AS seen, round(100 * seen / total, 4)::DOUBLE AS percent FROM r WHERE batch_id % 5 = 0",
    "chat_prompt": "WITH p AS (SELECT conv_id, string_agg('<|' || role || '|>' || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY turn) || '<|assistant|>' || chr(10) AS prompt FROM conversations GROUP BY 1) SELECT conv_id, md5(prompt) AS prompt_md5, length(prompt)::INT AS n_chars FROM p",
    "pad_sequences": K + ", l AS (SELECT *, max(len(ids)) OVER (PARTITION BY conv_id) AS most FROM k) SELECT conv_id, turn, array_to_string(list_concat(list_transform(range(most - len(ids)), lambda i: -1), ids), ',') AS ids FROM l",
    "trim_prefix": K + "SELECT conv_id, turn, array_to_string(ids[4:], ',') AS rest FROM k",
}
