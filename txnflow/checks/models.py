"""Features, undersampling, classifier, and streaming with a trained model.

Labels of the test tables have no relation to the features, so the model's quality means nothing here.
"""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from txnflow.checks.registry import AS_OF, query, with_enriched, with_parts
from txnflow.checks.relational import FRACTION_SQL, enriched as derived
from txnflow.checks.tables import TIME, customers, transaction_messages
from txnflow.operators.features import FeatureModel, fit_features, frequency_index, hot_place, vector_size
from txnflow.operators.forest import load_model, save_model, score, train_forest as fit_forest, use_model
from txnflow.operators.metrics import weighted_f1
from txnflow.operators.route import union_tables
from txnflow.operators.split import hash_split
from txnflow.operators.undersample import cluster_cells, kmeans_undersample as centres_of
from txnflow.plans.inference import score_stream, start_keyed_inference
from txnflow.plans.training import balanced_train, run_training, train_classifier as fit_classifier
from txnflow.schemas import FEATURES, FRAUD, LABEL, NON_FRAUD
from txnflow.sinks.keyed import read_keyed_table
from txnflow.sinks.tables import save_table
from txnflow.sources.tables import load_table
from txnflow.streaming.queries import start_named
from txnflow.streaming.transactions import CardHolders
from txnflow.workspace import materialize, scratch_path

# Taken as nominal in the test tables; their merchants grow beyond the bins of a forest.
CODED = ("category",)
TRAIN_SQL = f"train as (select * from enriched where {FRACTION_SQL} < 0.7)"
# Trained models by (application, folder of tables): training once serves all queries that only score.
_models: dict[tuple[str, str], str] = {}


def enriched(spark, sf_dir):
    """Enriched transactions as a stored table: training passes over them several times."""
    return materialize(derived(spark, sf_dir), "transaction")


def _model(spark, sf_dir):
    """(features, forest), trained on the train rows and loaded from storage."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _models:
        path = scratch_path(spark, "model")
        trained = fit_classifier(enriched(spark, sf_dir), nominal=CODED, measure=False)
        save_model(trained.features, trained.forest, path)
        _models[key] = path
    return load_model(spark, _models[key])


def _train(spark, sf_dir):
    return hash_split(enriched(spark, sf_dir))[0]


# --- feature operators, comparable with SQL ---

def _index_sql(column):
    return (f"{column}_labels as (select {column}, row_number() over (order by count(*) desc, {column}) - 1 as position "
            f"from train where {column} is not null group by {column})")


def _indexed_sql(select):
    labels = ", ".join(_index_sql(c) for c in ("cc_num", "category", "merchant"))
    joins = " ".join(f"left join {c}_labels using ({c})" for c in ("cc_num", "category", "merchant"))
    return with_parts(f", train as (select * from enriched where {FRACTION_SQL} < 0.7), {labels} "
                      f"select {select} from enriched {joins}", "customers", "transactions", "enriched")


def _position_sql(column):
    return f"cast(coalesce({column}_labels.position, (select count(*) from {column}_labels)) as double)"


@query(with_enriched(f"""
, counted as (select merchant, count(*) as n from enriched group by merchant)
select merchant, n, row_number() over (order by n desc, merchant) - 1 as position from counted"""))
def category_index(spark, sf_dir):
    return frequency_index(derived(spark, sf_dir).select("merchant"), "merchant")


FEATURE_SQL = ", ".join(
    [f"{_position_sql(c)} as {c}_index" for c in ("cc_num", "category", "merchant")]
    + ["distance", "amt", "cast(age as double) as age"]
)


def _vectors(df, names=("cc_num_index", "category_index", "merchant_index", "distance", "amt", "age")):
    values = vector_to_array("features")
    return df.select("trans_num", *[values[i].alias(n) for i, n in enumerate(names)])


@query(_indexed_sql(f"trans_num, {FEATURE_SQL}"))
def feature_vector(spark, sf_dir):
    """Vectors of all rows from features fitted on the train rows, unseen categories included."""
    rows = enriched(spark, sf_dir)
    return _vectors(fit_features(hash_split(rows)[0], FEATURES, CODED).transform(rows))


@query(_indexed_sql(f"trans_num, {FEATURE_SQL}"))
def feature_tables(spark, sf_dir):
    """The same vectors with all category columns as ordinal numbers, as for very many categories."""
    rows = enriched(spark, sf_dir)
    return _vectors(fit_features(hash_split(rows)[0], FEATURES, nominal=()).transform(rows))


@query(with_parts(f""", train as (select * from enriched where {FRACTION_SQL} < 0.7)
select 'cc_num' as name, false as nominal, count(distinct cc_num) as labels from train
union all select 'category', true, count(distinct category) from train
union all select 'merchant', false, count(distinct merchant) from train
union all select name, false, cast(null as bigint) from (values ('distance'), ('amt'), ('age')) as numbers(name)""",
                  "customers", "transactions", "enriched"))
def feature_roles(spark, sf_dir):
    """What each feature counts as, and its number of labels, as saved with the model."""
    path = scratch_path(spark, "features")
    fit_features(_train(spark, sf_dir), FEATURES, CODED).save(path)
    return FeatureModel.load(spark, path).roles(spark)


@query(_indexed_sql(f"""trans_num,
  cast(case when category_labels.position is null then -1 else category_labels.position end as bigint) as category_hot,
  cast(case when merchant_labels.position is null then -1 else merchant_labels.position end as bigint) as merchant_hot,
  (select count(*) from category_labels) as category_width, (select count(*) from merchant_labels) as merchant_width"""))
def one_hot(spark, sf_dir):
    """Place of the one in each one-hot vector, -1 if there is none, and the vector's width."""
    rows = enriched(spark, sf_dir)
    features = fit_features(hash_split(rows)[0], ["category", "merchant", "amt"], max_bins=1 << 20, one_hot=True)
    coded = features.transform(rows)
    return coded.select(
        "trans_num",
        *[hot_place(f"{c}_one_hot").alias(f"{c}_hot") for c in ("category", "merchant")],
        *[vector_size(f"{c}_one_hot").alias(f"{c}_width") for c in ("category", "merchant")],
    )


# --- models: what SQL can say of them ---

# Rows are equal where all features are; the number of distinct negatives bounds the centres.
_DISTINCT_SQL = ("(select count(*) from (select distinct cc_num, category, merchant, distance, amt, age from train where is_fraud = 0 "
                 "and amt is not null and distance is not null and age is not null))")


def _clustered(spark, sf_dir):
    train = _train(spark, sf_dir)
    features = fit_features(train, FEATURES, CODED)
    vectors = materialize(features.transform(train).select("features", LABEL), "vectors")
    k = vectors.where(F.col(LABEL) == 1).count()
    return cluster_cells(vectors.where(F.col(LABEL) == 0).select("features"), k)


@query(with_parts(f""", {TRAIN_SQL}
select least(count(*) filter (where is_fraud = 1), {_DISTINCT_SQL}) as centres,
  cast(count(*) filter (where is_fraud = 0) as double) as weight, cast(0 as bigint) as empty from train""",
                  "customers", "transactions", "enriched"))
def undersample_invariants(spark, sf_dir):
    """Centres of the non-fraud train rows: how many, how many rows they stand for, and how many stand for none."""
    return _clustered(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("centres"), F.sum("weight").alias("weight"), F.count_if(F.col("weight") < 1).alias("empty"))


@query(with_parts(f""", {TRAIN_SQL}
select least(count(*) filter (where is_fraud = 1), {_DISTINCT_SQL}) as centres,
  cast(6 as integer) as features, true as within from train""", "customers", "transactions", "enriched"))
def kmeans_undersample(spark, sf_dir):
    """As many centres of the non-fraud train rows as there are fraud train rows: their number, width, and whether they lie among the rows."""
    train = _train(spark, sf_dir)
    features = fit_features(train, FEATURES, CODED)
    vectors = materialize(features.transform(train).select("features", LABEL), "vectors")
    negatives = vectors.where(F.col(LABEL) == 0)
    centres = centres_of(negatives, vectors.where(F.col(LABEL) == 1).count())
    amount = vector_to_array("features")[4]
    bounds = negatives.agg(F.min(amount).alias("low"), F.max(amount).alias("high"))
    # Sums of many numbers may miss a bound by their rounding.
    inside = amount.between(F.col("low") - 1e-6, F.col("high") + 1e-6)
    return centres.join(F.broadcast(bounds)).agg(
        F.count(F.lit(1)).alias("centres"), F.max(F.size(vector_to_array("features"))).alias("features"), F.every(inside).alias("within"))


@query("""
select * from (values (0, 'cc_num', true), (1, 'category', true), (2, 'merchant', true), (3, 'distance', true),
  (4, 'amt', true), (5, 'age', true)) as found("position", feature, sums_to_one)""")
def train_forest(spark, sf_dir):
    """The features of a forest trained on the balanced train rows, in order, and whether their importances add up."""
    features, rows, *_ = balanced_train(_train(spark, sf_dir), nominal=CODED)
    importance = fit_forest(rows).featureImportances.toArray()
    whole = bool(abs(importance.sum() - 1) < 1e-9 and len(importance) == len(features.columns))
    return spark.createDataFrame([(i, c, whole) for i, c in enumerate(features.columns)], "position int, feature string, sums_to_one boolean")


@query(with_enriched(f"""
select cc_num, trans_time, trans_num, category, merchant, amt, merch_lat, merch_long, distance, age, is_fraud, true as is_class
from enriched where {FRACTION_SQL} >= 0.7"""))
def batch_score(spark, sf_dir):
    """All test rows, and whether each has one of the two classes as its prediction."""
    _, test = hash_split(enriched(spark, sf_dir))
    scored = score(test, *_model(spark, sf_dir))
    return scored.withColumn("is_class", F.coalesce(F.col("prediction").isin(0.0, 1.0), F.lit(False))).drop("prediction")


@query(with_enriched("""
select count(*) as n, cast(0 as bigint) as differing from enriched"""))
def model_roundtrip(spark, sf_dir):
    """All rows scored by a model as trained and as loaded again: how many, and how many come out different."""
    rows = enriched(spark, sf_dir)
    features, rows_train, *_ = balanced_train(hash_split(rows)[0], ["category", "merchant", "distance", "amt", "age"], CODED)
    forest = fit_forest(rows_train)
    path = scratch_path(spark, "model")
    save_model(features, forest, path)
    again = score(score(rows, features, forest, "before"), *load_model(spark, path), "after")
    return again.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.col("before").eqNullSafe(F.col("after"))).alias("differing"),
    )


@query(with_enriched("""
select count(*) as n, cast(0 as bigint) as differing, true as newer_in_force, true as older_again from enriched"""))
def model_retrained(spark, sf_dir):
    """All rows scored by a model that was loaded before another one was saved to its path: how many, how many come out different
    from the scores before, and whether the newer model, then the older one again, is loaded."""
    rows, path = enriched(spark, sf_dir), scratch_path(spark, "model")
    older, newer = (_small(rows, n) for n in (3, 2))
    first = save_model(*older, path)
    held = load_model(spark, path)
    save_model(*newer, path)
    trees = load_model(spark, path)[1].getNumTrees
    use_model(spark, path, first)
    again = load_model(spark, path)[1].getNumTrees
    both = score(score(rows, *older, "before"), *held, "after")
    return both.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("before").eqNullSafe(F.col("after"))).alias("differing"),
        F.lit(trees == 2).alias("newer_in_force"), F.lit(again == 3).alias("older_again"))


def _small(rows, trees):
    """A forest of few trees on unbalanced rows."""
    features = fit_features(rows, ["category", "distance", "amt", "age"], CODED, handle_invalid="skip")
    # The forest passes over its rows once for each level and several times before.
    vectors = materialize(features.transform(rows).select("features", LABEL), "vectors")
    return features, fit_forest(vectors, label_col=LABEL, numTrees=trees, maxDepth=3)


@query(with_parts(f""", {TRAIN_SQL}
select count(*) filter (where is_fraud = 1) as train_fraud, count(*) filter (where is_fraud = 0) as train_non_fraud,
  true as metric_holds from train""", "customers", "transactions", "enriched"))
def train_classifier(spark, sf_dir):
    """The training job from a stored table: sizes of the train set, and whether its metric is that of the scored test rows."""
    table, model = scratch_path(spark, "transaction"), scratch_path(spark, "model")
    save_table(derived(spark, sf_dir), path=table)
    trained = run_training(spark, table, model, nominal=CODED)
    scored = score(hash_split(load_table(spark, path=table))[1], *load_model(spark, model))
    again = weighted_f1(scored, LABEL).first()[0]
    return spark.createDataFrame(
        [(trained.train_fraud, trained.train_non_fraud, abs(trained.weighted_f1 - again) < 1e-9)],
        "train_fraud bigint, train_non_fraud bigint, metric_holds boolean")


# --- streams with a model ---

@query(with_enriched("select count(*) as n, cast(0 as bigint) as differing from enriched"))
def stream_score(spark, sf_dir):
    """All messages scored in a stream: how many, and how many differ from the batch scores of the same rows."""
    features, forest = _model(spark, sf_dir)
    path = scratch_path(spark, "scored")
    with CardHolders(customers(spark, sf_dir), features=features) as holders:
        messages = transaction_messages(spark, sf_dir, stream=True)
        stream = score_stream(messages, holders, features, forest, AS_OF, TIME)
        start_named(stream, "scored", path, watermark=None, availableNow=True).awaitTermination()
    streamed = spark.read.parquet(path).withColumnRenamed(LABEL, "prediction")
    batch = score(derived(spark, sf_dir).drop(LABEL), features, forest)
    rows = streamed.withColumn("streamed", F.lit(1)).unionByName(batch.withColumn("streamed", F.lit(-1)))
    # Every row must occur as often in one as in the other. Rows are told apart by 128 bits of hashes; a hash passes over NULL, so their places are hashed too.
    holes = F.array(*[F.col(c).isNull() for c in batch.columns])
    balance = rows.groupBy(*[F.xxhash64(F.lit(k), holes, *batch.columns).alias(f"hash_{k}") for k in range(2)]).agg(
        F.count_if(F.col("streamed") == 1).alias("n"), F.sum("streamed").alias("surplus"))
    return balance.agg(F.sum("n").alias("n"), F.sum(F.abs("surplus")).alias("differing"))


@query(with_enriched("select distinct cc_num, trans_time, true as is_class from enriched"))
def stream_inference(spark, sf_dir):
    """The inference job: all messages scored, routed, and each batch written into both keyed tables; their keys and whether
    each row's class is that of its table."""
    features, forest = _model(spark, sf_dir)
    tables = scratch_path(spark, "keyed")
    holders = CardHolders(customers(spark, sf_dir), features=features)
    messages = transaction_messages(spark, sf_dir, stream=True)
    start_keyed_inference(messages, holders, features, forest, tables, as_of=AS_OF, time_type=TIME, availableNow=True).awaitTermination()
    schema = score_stream(messages, holders, features, forest, AS_OF, TIME).schema
    fraud, other = (read_keyed_table(spark, f"{tables}/{r}", schema).withColumn("expected", F.lit(v)) for r, v in ((FRAUD, 1.0), (NON_FRAUD, 0.0)))
    rows = union_tables(fraud, other)
    return rows.groupBy("cc_num", "trans_time").agg(F.every(F.col(LABEL) == F.col("expected")).alias("is_class"))
