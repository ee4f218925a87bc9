"""Assembly of a report: one row a feature with all fields of the dashboard schema.

Each part is a table keyed by feature_id whose arrays have bounded length (rows of a table, bins, sequences of a
group), so the parts are joined on the feature and nothing larger than a feature's report ever meets in one row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actlake.functions import text as tx
from actlake.functions.vectors import head_shares, l1_share
from actlake.operators import corr, encode, sequences, stats, topk
from actlake.operators import prompts as pr

UNKNOWN = "UNK"


@dataclass(frozen=True)
class Settings:
    """What a report holds."""

    table_rows: int = 3
    logit_rows: int = 10
    bins: int = 50
    intervals: int = 5
    top: int = 20
    per_interval: int = 5
    before: int | None = None
    after: int = 0
    batch: int = 128
    heads: int | None = None
    seed: int = 0
    dataset: str = ""


def named(df: DataFrame, vocab: DataFrame) -> DataFrame:
    """Adds token; UNKNOWN for ids that the vocabulary lacks."""
    return df.join(vocab.select("token_id", "token"), "token_id", "left").withColumn("token", F.coalesce("token", F.lit(UNKNOWN)))


def listed(df: DataFrame, order: str, *columns: Column) -> list[Column]:
    """One array for each column over a feature's rows in order; for an aggregation by feature."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_at"), *(c.alias(f"c{i}") for i, c in enumerate(columns)))))
    return [F.transform(rows, lambda x: x[f"c{i}"]) for i in range(len(columns))]  # noqa: B023


class Report:
    """The parts of a report on the features of one model run.

    feat_acts: feature_id, prompt_idx, pos, token_id, act > 0. acts: prompt_idx, pos, token_id, act (array). save()
    writes a table and reads it again. dfa: a function that gives records for rows of feature_id, prompt_idx, or None.
    counted: feature_id, act, n, how often each activation occurs, if that is known.
    """

    def __init__(self, *, feat_acts: DataFrame, token_pos: DataFrame, prompts: DataFrame, vocab: DataFrame, acts: DataFrame, encoder: DataFrame, decoder: DataFrame, unembed: DataFrame, positions: int, save: Callable[[DataFrame], DataFrame], settings: Settings | None = None, dfa: Callable[[DataFrame], DataFrame] | None = None, counted: DataFrame | None = None):
        self.feat_acts, self.token_pos, self.prompts, self.vocab, self.acts = feat_acts, token_pos, prompts, vocab, acts
        self.encoder, self.decoder, self.unembed, self.positions = encoder, decoder, unembed, positions
        self.save, self.settings, self.dfa, self.counted = save, settings or Settings(), dfa, counted
        self.features = encoder.select("feature_id")

    def tables(self) -> DataFrame:
        """Neuron alignment, correlated neurons and correlated features, rounded to 5 places. Cosines go under the name `l1`, as viewers expect."""
        k, r5 = self.settings.table_rows, lambda c: F.round(c, 5)
        rows = self.decoder.select("feature_id", "w_dec", F.posexplode("w_dec").alias("idx", "v"))
        aligned = topk.top_k(rows, ["feature_id"], [F.desc("v"), F.asc("idx")], k)
        own = listed(aligned, "rank", F.col("idx"), r5(F.col("v")), r5(l1_share(F.col("v"), F.col("w_dec"))))
        aligned = aligned.groupBy("feature_id").agg(*(c.alias(f"neuron_alignment_{n}") for c, n in zip(own, ("indices", "values", "l1"))))
        neurons = corr.finalise(corr.neuron_sums(self.acts, self.encoder)).withColumn("pearson", r5("pearson"))
        neurons = topk.top_k(neurons, ["feature_id"], [F.desc("pearson"), F.asc("idx")], k)
        pairs = corr.feature_gram(self.acts, self.encoder, pr.balanced_batches(self.features, self.settings.batch), self.positions).withColumn("pearson", r5("pearson"))
        pairs = topk.top_k(pairs.select(F.col("x_id").alias("feature_id"), F.col("y_id").alias("idx"), "pearson", "cossim"), ["feature_id"], [F.desc("pearson"), F.asc("idx")], k)
        out = aligned
        for rows, name in ((neurons, "neurons"), (pairs, "features")):
            cols = listed(rows, "rank", F.col("idx"), r5("cossim"), F.col("pearson"))
            out = out.join(rows.groupBy("feature_id").agg(*(c.alias(f"correlated_{name}_{n}") for c, n in zip(cols, ("indices", "l1", "pearson")))), "feature_id", "left")
        return out

    def logits(self) -> DataFrame:
        """The tokens that a feature pushes most and least, with their logits rounded to 5 places."""
        sides = []
        for name, smallest in (("pos", False), ("neg", True)):
            top = named(encode.logit_lens_top(self.decoder, self.unembed, self.settings.logit_rows, smallest), self.vocab)
            strings, values = listed(top, "rank", F.col("token"), F.round("logit", 5))
            sides.append(top.groupBy("feature_id").agg(strings.alias(f"{name}_str"), values.alias(f"{name}_values")))
        return sides[0].join(sides[1], "feature_id")

    def histograms(self) -> DataFrame:
        """Bars of activations and of logits, and the share of active positions to 3 decimals of a percent."""
        out = stats.density(self.feat_acts, self.features, self.positions).select("feature_id", F.round(F.round(F.col("n_active") / self.positions * 100, 3) / 100, 8).alias("frac_nonzero"))
        acts = stats.histogram(self.feat_acts.select("feature_id", "act"), "feature_id", "act", self.settings.bins)
        for bars, name in ((acts, "freq"), (encode.logit_histogram(self.decoder, self.unembed, self.settings.bins, self.save), "logits")):
            heights, values = listed(bars, "bin", F.col("height").cast("int"), F.col("bar_value"))
            out = out.join(bars.groupBy("feature_id").agg(heights.alias(f"{name}_hist_data_bar_heights"), values.alias(f"{name}_hist_data_bar_values")), "feature_id", "left")
        return out

    def decoder_shares(self) -> DataFrame:
        """Norm of each head's block of the decoder; null without heads."""
        heads = self.settings.heads
        shares = head_shares(F.col("w_dec"), heads, F.floor(F.size("w_dec") / heads).cast("int")) if heads else F.lit(None).cast("array<double>")
        return self.decoder.select("feature_id", shares.alias("decoder_weights_dist"))

    @cached_property
    def groups(self) -> DataFrame:
        return self.save(sequences.groups(self.feat_acts, self.positions, self.settings.intervals, self.counted))

    @cached_property
    def rows(self) -> DataFrame:
        """The sequences of all groups with window, start and acts; windows without a token are left out."""
        s = self.settings
        if s.intervals:
            members = sequences.members(self.feat_acts, self.token_pos, self.groups, s.top, s.per_interval, s.seed, self.counted, self.save)
        else:
            members = topk.top_positions(self.feat_acts, s.top, counted=self.counted).select("feature_id", F.lit(0).alias("group_ord"), "rank", "prompt_idx", "pos", "act")
        members = self.save(members)
        return self.save(sequences.window_acts(sequences.windows(members, self.token_pos, s.before, s.after), self.feat_acts).where(F.size("window") > 0))

    def packaged(self) -> DataFrame:
        """One row a feature: its groups in order with their sequences, each with the logits of its tokens."""
        return sequences.packaged(sequences.with_token_logits(self.rows, self.decoder, self.unembed), self.groups)

    def activations(self) -> DataFrame:
        """feature_id and activations: the sequences of all groups in order. Bounds are those of the groups' titles.

        With whole prompts the first token is dropped from tokens and values, so indices are one less; the first source
        is dropped from the attribution too, and its maximum is taken anew. A sequence without attribution has none.
        """
        title = tx.title_bounds(tx.group_title(F.col("kind"), F.col("lower"), F.col("upper"), F.col("pct")))
        bounds = self.groups.select("feature_id", "group_ord", title.alias("b"))
        places = self.rows.select("feature_id", "group_ord", "rank", F.posexplode("window").alias("i", "token_id"))
        strings = named(places, self.vocab).groupBy("feature_id", "group_ord", "rank").agg(*(c.alias("tokens") for c in listed(places, "i", F.col("token"))))
        rows = self.rows.join(strings, ["feature_id", "group_ord", "rank"]).join(bounds, ["feature_id", "group_ord"])
        if self.dfa is None:
            rows = rows.withColumn("own", F.lit(None).cast("array<double>")).withColumn("target", F.lit(0))
        else:
            found = self.dfa(self.rows.select("feature_id", "prompt_idx").distinct())
            rows = rows.join(found.select("feature_id", "prompt_idx", F.expr("slice(dfa_values, 2, size(dfa_values))").alias("own"), F.col("dfa_target_index").alias("target")), ["feature_id", "prompt_idx"], "left")
        dfa = F.coalesce("own", F.array().cast("array<double>"))
        one = F.struct(
            "group_ord", "rank", F.col("b.bin_min").alias("bin_min"), F.col("b.bin_max").alias("bin_max"), F.round("b.bin_contains", 8).alias("bin_contains"), "tokens", F.col("acts").alias("values"), (F.col("pos") - 1).cast("int").alias("qualifying_token_index"),
            dfa.alias("dfa_values"), F.coalesce(F.array_max(dfa), F.lit(0.0)).alias("dfa_maxValue"), F.when(F.col("own").isNull(), -1).otherwise(F.col("target") - 1).cast("int").alias("dfa_targetIndex"),
        )
        ordered = F.array_sort(F.collect_list(one))
        return rows.groupBy("feature_id").agg(F.transform(ordered, lambda a: a.dropFields("group_ord", "rank")).alias("activations"))

    def dashboard(self, vectors: DataFrame | None = None) -> DataFrame:
        """One row a feature with all fields of schemas.FEATURE; vectors: feature_id, vector of vector sets."""
        n = self.prompts.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("token_ids")).alias("t")).first()
        vectors = self.features.withColumn("vector", F.lit(None).cast("array<double>")) if vectors is None else vectors.select("feature_id", "vector")
        parts = [self.features, self.tables(), self.logits(), self.histograms(), self.decoder_shares(), self.activations(), vectors]
        out = reduce(lambda a, b: a.join(b, "feature_id", "left"), parts)
        about = {"n_prompts_total": F.lit(n["n"]).cast("long"), "n_tokens_in_prompt": F.lit(n["t"]).cast("int"), "dataset": F.lit(self.settings.dataset)}
        return out.withColumns(about).withColumnRenamed("feature_id", "feature_index")


def bar_colours(values: Column) -> Column:
    """A colour for each bar, darker at higher values: from 0.4 of the scale on."""
    top = F.array_max(values)
    return F.transform(values, lambda v: tx.warm_colour((0.4 * top + 0.6 * v) / F.greatest(top, F.lit(1e-6))))


def histogram_payloads(features: DataFrame) -> DataFrame:
    """feature_index, actsHistogram and logitsHistogram: heights y, centres x and ticks of the bars, and colours and title of the first. features: rows of the dashboard schema."""
    acts, logits = F.col("freq_hist_data_bar_values"), F.col("logits_hist_data_bar_values")
    title = F.concat(F.lit("ACTIVATIONS<br>DENSITY = "), F.format_string("%.3f%%", F.round(F.col("frac_nonzero") * 100, 3)))
    return features.select(
        "feature_index",
        F.struct(F.col("freq_hist_data_bar_heights").alias("y"), acts.alias("x"), stats.int_ticks(F.array_max(acts)).alias("ticks"), bar_colours(acts).alias("colors"), title.alias("title")).alias("actsHistogram"),
        F.struct(F.col("logits_hist_data_bar_heights").alias("y"), logits.alias("x"), stats.ticks(F.array_min(logits), F.array_max(logits)).alias("ticks")).alias("logitsHistogram"),
    )


def sequence_payloads(packaged: DataFrame, vocab: DataFrame) -> DataFrame:
    """feature_id and groups (group_ord, title, sequences of rank and tokens): a record for each token of each sequence.

    packaged: as Report.packaged() gives it. A record has tok, tokID and tokenLogit (4 decimals), isBold at the sequence's own
    position, and where the feature is active featAct (4 decimals) and bgColor, by its share of the feature's largest
    activation in all sequences; elsewhere these are null. A group is a bounded number of bounded sequences.
    """
    groups = packaged.select("feature_id", F.explode("groups").alias("g"))
    rows = groups.select("feature_id", "g.group_ord", F.explode("g.sequences").alias("s"))
    top = rows.groupBy("feature_id").agg(F.max(F.array_max("s.feat_acts")).alias("_top"))
    start = F.col("s.qualifying_token_index") - F.coalesce(F.col("s.start"), F.lit(0))  # the own position's place in the window
    places = rows.select("feature_id", "group_ord", "s.rank", start.alias("_own"), F.posexplode(F.arrays_zip("s.token_ids", "s.feat_acts", "s.token_logits")).alias("_i", "x"))
    places = named(places.select("feature_id", "group_ord", "rank", "_own", "_i", F.col("x.token_ids").alias("token_id"), F.col("x.feat_acts").alias("act"), F.col("x.token_logits").alias("logit")), vocab).join(top, "feature_id")
    denominator = F.greatest(F.lit(1e-4), F.when(F.col("_top") > 0, F.col("_top")).otherwise(1.0))
    live = F.abs("act") > 1e-8
    one = F.struct(
        "_i", F.col("token").alias("tok"), F.col("token_id").alias("tokID"), F.round("logit", 4).alias("tokenLogit"), (F.col("_i") == F.col("_own")).alias("isBold"),
        F.when(live, F.round("act", 4)).alias("featAct"), F.when(live, tx.warm_colour(F.greatest(F.col("act"), F.lit(0.0)) / denominator)).alias("bgColor"),
    )
    sequences_ = places.groupBy("feature_id", "group_ord", "rank").agg(F.transform(F.array_sort(F.collect_list(one)), lambda t: t.dropFields("_i")).alias("tokens"))
    per_group = sequences_.groupBy("feature_id", "group_ord").agg(F.array_sort(F.collect_list(F.struct("rank", "tokens"))).alias("sequences"))
    titles = groups.select("feature_id", "g.group_ord", tx.group_title(F.col("g.kind"), F.col("g.lower"), F.col("g.upper"), F.col("g.pct")).alias("title"))
    full = titles.join(per_group, ["feature_id", "group_ord"], "left").withColumn("sequences", F.coalesce("sequences", F.expr("array()")))
    return full.groupBy("feature_id").agg(F.array_sort(F.collect_list(F.struct("group_ord", "title", "sequences"))).alias("groups"))


def payloads(features: DataFrame) -> DataFrame:
    """feature_index and what a page's components show, as text: tables with signs and percentages, logits and bars with colours.

    features: rows of the dashboard schema. Bars are darker at higher values; logits are coloured by their share of the
    largest absolute one on either side.
    """
    signed, share = (lambda v: F.format_string("%+.3f", F.round(v, 3))), (lambda v: F.format_string("%.1f%%", F.round(v * 100, 1)))

    def table(index: str, value: str, other: str, shown: Callable[[Column], Column]) -> Column:
        return F.transform(F.arrays_zip(index, value, other), lambda x: F.struct(x[index].alias("index"), signed(x[value]).alias("value"), shown(x[other]).alias("percentageL1")))

    size = F.greatest(*(F.coalesce(F.array_max(F.transform(c, F.abs)), F.lit(0.0)) for c in ("pos_values", "neg_values")))
    size = F.when(size > 0, size).otherwise(1.0)
    fade = lambda v: F.floor(255 * (1 - F.abs(v) / size)).cast("int")
    rgb = lambda v: F.when(v >= 0, F.format_string("rgba(%d,%d,255,0.5)", fade(v), fade(v))).otherwise(F.format_string("rgba(255,%d,%d,0.5)", fade(v), fade(v)))
    side = lambda c: F.transform(F.arrays_zip(f"{c}_str", f"{c}_values"), lambda x: F.struct(x[f"{c}_str"].alias("symbol"), F.round(x[f"{c}_values"], 2).alias("value"), rgb(x[f"{c}_values"]).alias("color")))
    return features.select(
        "feature_index",
        table("neuron_alignment_indices", "neuron_alignment_values", "neuron_alignment_l1", share).alias("neuronAlignment"),
        table("correlated_neurons_indices", "correlated_neurons_pearson", "correlated_neurons_l1", signed).alias("correlatedNeurons"),
        table("correlated_features_indices", "correlated_features_pearson", "correlated_features_l1", signed).alias("correlatedFeatures"),
        side("pos").alias("posLogits"), side("neg").alias("negLogits"),
        bar_colours(F.col("freq_hist_data_bar_values")).alias("actsHistogramColors"),
    )
