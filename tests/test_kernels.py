"""Functions that need no session."""

import math

import numpy as np
import pytest

from tidepeak.config import PROFILES, Scoring, TwoStage, profile_rows
from tidepeak.operators.detect import find_peaks
from tidepeak.operators.evaluate import coordinate_search, random_candidates
from tidepeak.operators.manifest import hash_json, step_range
from tidepeak.operators.normalize import normalised_weights
from tidepeak.sources import frames


def test_peaks_take_the_middle_of_a_plateau_and_never_an_end():
    assert find_peaks(np.array([3, 1, 2, 2, 2, 1, 5])).tolist() == [3]
    assert find_peaks(np.array([1.0, 1.0])).tolist() == [] and find_peaks(np.array([])).tolist() == []


def test_close_peaks_lose_to_higher_ones_and_ties_to_later_ones():
    assert find_peaks(np.array([0, 3, 0, 5, 0, 2, 0]), distance=3).tolist() == [3]
    assert find_peaks(np.array([0, 5, 0, 5, 0]), distance=3).tolist() == [3]


def test_prominence_is_measured_to_the_next_higher_tick():
    x = np.array([0, 5, 4, 4.5, 0, 9, 0])
    assert find_peaks(x, prominence=1).tolist() == [1, 5]
    assert find_peaks(x, height=4.6).tolist() == [1, 5]


@pytest.mark.parametrize("n", [0, 1, 127, 128, 300, 2**40])
def test_varints_round_trip(n):
    frame = {"seq_id": n, "payload": b"\x00\x01", "payload_encoding": "gzip", "headers": {"a": "b"}, "msg_id": "é"}
    out = frames.decode(frames.encode(frame))
    assert out["seq_id"] == n and out["payload"] == b"\x00\x01" and out["headers"] == [("a", "b")] and out["msg_id"] == "é"


def test_frames_skip_unknown_fields_and_reject_negatives():
    unknown = frames.varint(99 * 8) + frames.varint(5) + frames.varint(98 * 8 + 2) + frames.varint(2) + b"xy" + frames.varint(97 * 8 + 5) + b"1234"
    assert frames.decode(unknown + frames.encode({"service": 7}))["service"] == 7
    assert frames.decode(None) is None and frames.decode(b"")["payload"] == b""
    with pytest.raises(ValueError):
        frames.varint(-1)
    assert [frames.zigzag(n) for n in (0, 1, 2, 3)] == [0, -1, 1, -2]


def test_profiles_sum_to_one_and_settings_are_checked():
    for p in PROFILES:
        assert math.isclose(sum(w for q, _, w in profile_rows() if q == p), 1)
    for bad in (lambda: Scoring(min_duration=100), lambda: Scoring(ewma_alpha=0), lambda: TwoStage(per_hour=0), lambda: normalised_weights({"x": 1})):
        with pytest.raises(ValueError):
            bad()
    assert normalised_weights({"rms": 3, "motion": 1, "zcr": -2}) == {"rms": 0.75, "motion": 0.25}


def test_weight_search_is_seeded_and_improves():
    base = {"rms": 0.5, "motion": 0.5}
    assert random_candidates(base, 3, 1) == random_candidates(base, 3, 1)
    best = coordinate_search(lambda ws: [w["rms"] for w in ws], base)
    assert best["rms"] > 0.5 and math.isclose(sum(best.values()), 1)


def test_manifest_helpers():
    assert hash_json({"a": 1, "b": [2]}) == hash_json({"b": [2], "a": 1})
    steps = ("audio", "asr", "signal", "score", "clip")
    assert step_range(steps, first="signal") == ("signal", "score", "clip") and step_range(steps, only="asr") == ("asr",)
