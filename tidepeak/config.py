"""Settings with their defaults. Weights and tables are fixed values of the method."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Scoring:
    ewma_alpha: float = 0.3
    z_window: int = 60
    z_eps: float = 1e-10
    median_size: int = 5
    scales: tuple[int, ...] = (3, 10, 30)
    sensitivity: float = 2.5
    persistence: int = 3
    gap: int = 3
    merge_distance: float = 15.0
    min_duration: float = 15.0
    max_duration: float = 90.0
    trigger_z: float = 2.0
    decay: float = 0.1
    boost_divisor: float = 2.0
    penalty: float = 0.7
    p_value: float = 0.05
    before: int = 5
    valley_range: int = 10
    valley_radius: int = 5
    pad: int = 5

    def __post_init__(self) -> None:
        if not 0 < self.ewma_alpha <= 1:
            raise ValueError("ewma_alpha must be in (0, 1]")
        if self.min_duration > self.max_duration:
            raise ValueError("min_duration must not exceed max_duration")
        if self.persistence < 1 or not self.scales or min(self.scales) < 1:
            raise ValueError("persistence and scales must be positive")


@dataclass(frozen=True)
class TwoStage:
    per_hour: float = 60.0
    min_gap: float = 12.0
    prominence: float = 0.8
    window: float = 30.0
    agreement_z: float = 1.0
    onset: float = 0.2
    top_k: int = 20
    min_score: float = 0.0
    radius: int = 8
    overlap: float = 0.6
    edge_limit: int = 10

    def __post_init__(self) -> None:
        if self.per_hour <= 0 or self.min_gap < 0 or self.window <= 0:
            raise ValueError("per_hour and window must be positive, min_gap not negative")


#: Signal weights of each profile, before they are scaled to a sum of 1.
WEIGHT_NAMES = (
    "dmDensity", "dmAcceleration", "dmEntropy", "dmSentiment", "dmUtr", "dmUniqueUsers", "dmRepeatRate", "dmQuestionRate", "dmExclamationRate", "dmEmojiRate",
    "keywordHighEnergy", "keywordFunny", "keywordControversy", "keywordInteractive", "keywordEmotional", "keywordShopping",
    "asrKeyword", "topicChange", "speakerChange", "rms", "mfccDist", "eventLaughter", "eventApplause", "eventMusic", "sceneChange", "motion", "faceCount",
)
PROFILES = {
    "default": {
        "dmDensity": 0.15, "dmAcceleration": 0.05, "dmEntropy": 0.05, "dmSentiment": 0.10, "dmUtr": 0.03, "dmUniqueUsers": 0.05,
        "dmRepeatRate": 0.00, "dmQuestionRate": 0.02, "dmExclamationRate": 0.02, "dmEmojiRate": 0.02, "keywordHighEnergy": 0.04, "keywordFunny": 0.05,
        "keywordControversy": 0.02, "keywordInteractive": 0.03, "keywordEmotional": 0.03, "keywordShopping": 0.02, "asrKeyword": 0.10, "topicChange": 0.05,
        "speakerChange": 0.05, "rms": 0.10, "mfccDist": 0.02, "eventLaughter": 0.10, "eventApplause": 0.05, "eventMusic": 0.05,
        "sceneChange": 0.05, "motion": 0.05, "faceCount": 0.00,
    },
    "game": {
        "dmDensity": 0.19, "dmAcceleration": 0.09, "dmEntropy": 0.05, "dmSentiment": 0.05, "dmUtr": 0.03, "dmUniqueUsers": 0.04,
        "dmRepeatRate": 0.00, "dmQuestionRate": 0.02, "dmExclamationRate": 0.03, "dmEmojiRate": 0.01, "keywordHighEnergy": 0.06, "keywordFunny": 0.05,
        "keywordControversy": 0.03, "keywordInteractive": 0.03, "keywordEmotional": 0.01, "keywordShopping": 0.00, "asrKeyword": 0.07, "topicChange": 0.05,
        "speakerChange": 0.03, "rms": 0.07, "mfccDist": 0.02, "eventLaughter": 0.09, "eventApplause": 0.09, "eventMusic": 0.03,
        "sceneChange": 0.05, "motion": 0.09, "faceCount": 0.00,
    },
    "shopping": {
        "dmDensity": 0.12, "dmAcceleration": 0.04, "dmEntropy": 0.04, "dmSentiment": 0.06, "dmUtr": 0.04, "dmUniqueUsers": 0.06,
        "dmRepeatRate": 0.00, "dmQuestionRate": 0.03, "dmExclamationRate": 0.01, "dmEmojiRate": 0.01, "keywordHighEnergy": 0.02, "keywordFunny": 0.02,
        "keywordControversy": 0.02, "keywordInteractive": 0.04, "keywordEmotional": 0.01, "keywordShopping": 0.10, "asrKeyword": 0.22, "topicChange": 0.06,
        "speakerChange": 0.06, "rms": 0.06, "mfccDist": 0.02, "eventLaughter": 0.06, "eventApplause": 0.06, "eventMusic": 0.06,
        "sceneChange": 0.06, "motion": 0.04, "faceCount": 0.00,
    },
    "talent": {
        "dmDensity": 0.10, "dmAcceleration": 0.05, "dmEntropy": 0.03, "dmSentiment": 0.14, "dmUtr": 0.03, "dmUniqueUsers": 0.05,
        "dmRepeatRate": 0.00, "dmQuestionRate": 0.02, "dmExclamationRate": 0.02, "dmEmojiRate": 0.02, "keywordHighEnergy": 0.04, "keywordFunny": 0.04,
        "keywordControversy": 0.01, "keywordInteractive": 0.03, "keywordEmotional": 0.05, "keywordShopping": 0.00, "asrKeyword": 0.10, "topicChange": 0.05,
        "speakerChange": 0.10, "rms": 0.17, "mfccDist": 0.02, "eventLaughter": 0.05, "eventApplause": 0.05, "eventMusic": 0.05,
        "sceneChange": 0.03, "motion": 0.03, "faceCount": 0.00,
    },
}
#: Bonus of a signal that peaks in a window.
BOOSTS = {
    "eventLaughter": 0.18, "asrKeyword": 0.15, "keywordHighEnergy": 0.06, "keywordFunny": 0.10, "keywordControversy": 0.04, "keywordInteractive": 0.06, "keywordEmotional": 0.06, "keywordShopping": 0.04,
    "speakerChange": 0.12, "eventApplause": 0.12, "eventMusic": 0.08, "topicChange": 0.06, "sceneChange": 0.05, "dmSentiment": 0.04, "dmUniqueUsers": 0.04, "motion": 0.03,
}
#: Seconds that clips of a content type, and of a platform, should last.
DURATIONS = {"funny": (12.0, 35.0), "shopping": (20.0, 60.0), "interaction": (30.0, 90.0), "talent": (45.0, 120.0), "game": (15.0, 60.0), "default": (15.0, 90.0)}
PLATFORMS = {"douyin": (15.0, 60.0), "bilibili": (60.0, 180.0), "xiaohongshu": (15.0, 60.0)}
#: Trust in the sources of a boundary.
EDGE_WEIGHTS = {"asrSentence": 1.0, "silence": 0.9, "sceneChange": 0.8, "scoreValley": 0.7, "original": 0.2}
#: Quality targets of an evaluation; (name, limit, whether less is better).
TARGETS = (("precisionAtK", 0.60, False), ("recallAtK", 0.70, False), ("meanIou", 0.50, False), ("invalidRate", 0.20, True), ("duplicateRate", 0.10, True))


def profile_rows() -> list[tuple[str, str, float]]:
    """(profile, signal, weight), each profile scaled to a sum of 1."""
    return [(p, s, w / sum(ws.values())) for p, ws in PROFILES.items() for s, w in ws.items()]
