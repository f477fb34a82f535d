"""Table-independent column builders."""

from tallyframe.functions.geometry import batted_direction, location_direction, spray_angle
from tallyframe.functions.numeric import (
    bit_code,
    clip,
    harmonic,
    log_gamma,
    logistic,
    logit,
    negative_binomial_logpmf,
    ratio,
)
from tallyframe.functions.parsing import (
    exact_age,
    first_date,
    hash_fold,
    innings_to_outs,
    payload_hash,
    present,
    whole_number,
)
from tallyframe.functions.taxonomy import any_of, bands, first_case, map_value, member, with_text_groups

__all__ = [
    "any_of",
    "bands",
    "batted_direction",
    "bit_code",
    "clip",
    "exact_age",
    "first_case",
    "first_date",
    "harmonic",
    "hash_fold",
    "innings_to_outs",
    "location_direction",
    "log_gamma",
    "logistic",
    "logit",
    "map_value",
    "member",
    "negative_binomial_logpmf",
    "payload_hash",
    "present",
    "ratio",
    "spray_angle",
    "whole_number",
    "with_text_groups",
]
