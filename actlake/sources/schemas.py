"""Schemas of the documents that are read and written."""

from __future__ import annotations

from pyspark.sql import types as T

#: The field names are those of the documents that viewers and importers exchange.
_D = T.ArrayType(T.DoubleType())
_I = T.ArrayType(T.IntegerType())
_S = T.ArrayType(T.StringType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


ACTIVATION = _struct(bin_min=T.DoubleType(), bin_max=T.DoubleType(), bin_contains=T.DoubleType(), tokens=_S, values=_D, qualifying_token_index=T.IntegerType(), dfa_values=_D, dfa_maxValue=T.DoubleType(), dfa_targetIndex=T.IntegerType())
FEATURE = _struct(
    feature_index=T.IntegerType(), neuron_alignment_indices=_I, neuron_alignment_values=_D, neuron_alignment_l1=_D,
    correlated_neurons_indices=_I, correlated_neurons_l1=_D, correlated_neurons_pearson=_D,
    correlated_features_indices=_I, correlated_features_l1=_D, correlated_features_pearson=_D,
    neg_str=_S, neg_values=_D, pos_str=_S, pos_values=_D, frac_nonzero=T.DoubleType(),
    freq_hist_data_bar_values=_D, freq_hist_data_bar_heights=_I, logits_hist_data_bar_heights=_I, logits_hist_data_bar_values=_D,
    n_prompts_total=T.LongType(), n_tokens_in_prompt=T.IntegerType(), dataset=T.StringType(), decoder_weights_dist=_D,
    activations=T.ArrayType(ACTIVATION), vector=_D,
)
BATCH = _struct(model_id=T.StringType(), layer=T.StringType(), sae_set=T.StringType(), sae_id_suffix=T.StringType(), features=T.ArrayType(FEATURE))
