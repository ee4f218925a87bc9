"""Command line: dashboards and bulk exports from a user's own tables.

spark-submit actlake/plans/cli.py --activations A --encoder E --decoder D --unembed U --vocab V --out FOLDER ...

Tables are Parquet: activations (prompt_idx, pos, token_id, act array), encoder (feature_id, w_enc, b_enc, threshold if
--keep threshold), decoder (feature_id, w_dec), unembed (token_id, w_u), vocab (token_id, token). With --vectors a JSON
vector set takes the place of encoder and decoder. A run that was stopped goes on where it was: features come in
batches, and batches that the folder has already are left out. The bulk export takes all batches that the folder has.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actlake.functions.vectors import scale
from actlake.operators import encode, prompts
from actlake.plans.dashboard import Report, Settings
from actlake.plans.reports import output_folder
from actlake.sources import readers, sinks
from actlake.sources.cache import TableCache
from actlake.sources.exports import Export


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    tables = p.add_argument_group("tables")
    for name in ("activations", "encoder", "decoder", "unembed", "vocab"):
        tables.add_argument(f"--{name}", required=name in ("activations", "unembed", "vocab"))
    tables.add_argument("--vectors", help="JSON vector set; its vectors are probes with no bias")
    tables.add_argument("--norm-stats", help="JSON of means and deviations by layer; activations are normalised by them")
    tables.add_argument("--skipped", help="JSON lines with feature_id of features to leave out")
    tables.add_argument("--out", required=True)
    run = p.add_argument_group("run")
    run.add_argument("--model-id", required=True)
    run.add_argument("--sae-set", required=True)
    run.add_argument("--hook", default="hook_resid_post")
    run.add_argument("--layer", type=int, default=0)
    run.add_argument("--suffix", default="")
    run.add_argument("--dataset", default="")
    run.add_argument("--prompts", type=int, help="prompts to draw; all if left out")
    run.add_argument("--seed", type=int, default=0)
    run.add_argument("--batch-size", type=int, default=128)
    run.add_argument("--start-batch", type=int, default=0)
    run.add_argument("--end-batch", type=int, default=2**31 - 1, help="the last batch, included")
    masks = p.add_argument_group("activations")
    masks.add_argument("--keep", choices=("positive", "threshold"), default="positive")
    masks.add_argument("--batch-top-k", type=int, help="positions' number of features that are kept on average in a batch of prompts")
    masks.add_argument("--fold-decoder-norm", action="store_true")
    masks.add_argument("--high-norm", type=float, help="positions above so many times the median norm are zeroed")
    masks.add_argument("--prompts-per-batch", type=int, default=64)
    masks.add_argument("--ignore-tokens", type=int, nargs="*", default=[])
    masks.add_argument("--ignore-positions", type=int, nargs="*", default=[])
    layout = p.add_argument_group("layout")
    layout.add_argument("--top", type=int, default=20)
    layout.add_argument("--intervals", type=int, default=5)
    layout.add_argument("--per-interval", type=int, default=5)
    layout.add_argument("--before", type=int, help="tokens before an activation; whole prompts if left out")
    layout.add_argument("--after", type=int, default=0)
    layout.add_argument("--bins", type=int, default=50)
    layout.add_argument("--logit-rows", type=int, default=10)
    layout.add_argument("--table-rows", type=int, default=3)
    layout.add_argument("--heads", type=int)
    export = p.add_argument_group("bulk export, if a creator is named")
    for name in ("creator-id", "release-id", "release-title", "url", "created-at"):
        export.add_argument(f"--{name}", default="")
    export.add_argument("--zero-out-start", action="store_true")
    return p


def weights(spark: SparkSession, args: argparse.Namespace) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Encoder, decoder and, for vector sets, the vectors."""
    if args.vectors:
        own = readers.vector_set(spark, args.vectors)
        return own.select("feature_id", "w_enc", "b_enc"), own.select("feature_id", F.col("w_enc").alias("w_dec")), own.select("feature_id", F.col("w_enc").alias("vector"))
    if not (args.encoder and args.decoder):
        raise SystemExit("name --encoder and --decoder, or --vectors")
    encoder, decoder = spark.read.parquet(args.encoder), spark.read.parquet(args.decoder)
    if args.fold_decoder_norm:
        encoder = encode.fold_decoder_norm(encoder, decoder)
    return encoder, decoder, None


def inputs(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Activations of the drawn prompts, normalised and without outliers if that is asked for."""
    acts = spark.read.parquet(args.activations).withColumn("act", F.col("act").cast("array<double>"))
    if args.prompts is not None:
        drawn = prompts.sample(acts.select("prompt_idx").distinct(), args.prompts, args.seed)
        acts = acts.join(drawn, "prompt_idx", "left_semi")
    if args.norm_stats and (found := readers.norm_stats(spark, args.norm_stats, args.layer)):
        acts = encode.normalise_input(acts, *found)
    if args.high_norm is not None:
        acts = encode.high_norm_mask(acts, args.high_norm, args.prompts_per_batch).drop("_norm")  # `outlier` stays, so that no feature is active there
    return acts


def main(argv: list[str] | None = None) -> str:
    """Writes dashboard batches, and the bulk export if a creator is named; gives the folder back."""
    from actlake import ship

    args = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    ship(spark)
    encoder, decoder, vectors = weights(spark, args)
    every = encoder  # all features of the model take part in a selection over features
    if args.skipped:
        left_out = spark.read.schema("feature_id int").json(args.skipped)
        encoder = encoder.join(left_out, "feature_id", "left_anti")
    folder = output_folder(args.out, args.model_id, args.sae_set, args.hook, encoder.count(), args.suffix or None)
    batches = prompts.balanced_batches(encoder.select("feature_id"), args.batch_size).withColumn("batch_id", F.col("batch_id").cast("int"))
    done = spark.createDataFrame([(b,) for b in sinks.batch_ids(spark, f"{folder}/batches")], "batch_id int")
    wanted = batches.join(prompts.to_run(batches, done, args.start_batch, args.end_batch), "batch_id", "left_semi")
    if not wanted.isEmpty():
        run(spark, args, every, encoder, decoder, vectors, batches, wanted, folder)
    if args.creator_id:
        config = sinks.ExportConfig(args.model_id, args.creator_id, args.release_id, args.release_title, args.url, args.sae_set, args.layer, args.hook, args.suffix or None, args.zero_out_start)
        Export(spark, f"{folder}/export").write(readers.written_features(spark, f"{folder}/batches"), config, args.created_at)
    return folder


#: What of a run's arguments doesn't change its activations.
APART = ("out", "start_batch", "end_batch", "batch_size", "skipped", "batch_top_k", "top", "intervals", "per_interval", "before", "after", "bins", "logit_rows", "table_rows", "heads", "creator_id", "release_id", "release_title", "url", "created_at", "zero_out_start", "dataset", "suffix")


def run(spark: SparkSession, args: argparse.Namespace, every: DataFrame, encoder: DataFrame, decoder: DataFrame, vectors: DataFrame | None, batches: DataFrame, wanted: DataFrame, folder: str) -> None:
    """Writes the dashboards of the wanted batches. Results of a batch don't depend on which others are wanted."""
    cache = TableCache(spark, [args.activations], {"arguments": sorted((k, v) for k, v in vars(args).items() if k not in APART)})
    encoder, decoder = (w.join(wanted.select("feature_id"), "feature_id", "left_semi") for w in (encoder, decoder))
    acts = cache.load_or_build("acts", lambda: inputs(spark, args))
    found = encode.encode(acts, encoder, keep=args.keep)
    if args.batch_top_k is not None:
        edges = cache.load_or_build(f"edges-{args.batch_top_k}", lambda: encode.batch_top_k_edges(cache.save(encode.encode(acts, every, keep=args.keep)), args.batch_top_k, args.prompts_per_batch, cache.save))
        found = encode.above_edges(found, edges, args.prompts_per_batch).drop("batch_id")
    thresholds = encoder.select("feature_id", "threshold") if args.keep == "threshold" else None
    found = cache.save(encode.masked(found, args.ignore_tokens, args.ignore_positions, thresholds))
    token_pos = acts.select("prompt_idx", "pos", "token_id")
    texts = cache.save(prompts.texts(token_pos))
    settings = Settings(args.table_rows, args.logit_rows, args.bins, args.intervals, args.top, args.per_interval, args.before, args.after, args.batch_size, args.heads, args.seed, args.dataset)
    unembed = spark.read.parquet(args.unembed).withColumn("w_u", scale(F.col("w_u"), F.lit(1.0)))
    report = Report(feat_acts=found, token_pos=token_pos, prompts=texts, vocab=spark.read.parquet(args.vocab), acts=acts, encoder=encoder, decoder=decoder, unembed=unembed, positions=token_pos.count(), save=cache.save, settings=settings)
    rows = cache.save(report.dashboard(vectors).join(batches.withColumnRenamed("feature_id", "feature_index"), "feature_index"))
    head = {"model_id": args.model_id, "layer": str(args.layer), "sae_set": args.sae_set, "sae_id_suffix": args.suffix}
    sinks.write_batches(rows, head, f"{folder}/batches")


if __name__ == "__main__":
    main()
