"""Table contracts and the signal vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Signal names, in the order in which they count as first.
AUDIO = ("rms", "spectralCentroid", "mfccDist", "zcr", "eventLaughter", "eventApplause", "eventMusic")
TEXT = (
    "dmDensity", "dmAcceleration", "dmEntropy", "dmSentiment", "dmUniqueUsers", "dmUtr", "dmRepeatRate", "dmQuestionRate", "dmExclamationRate", "dmEmojiRate",
    "keywordHighEnergy", "keywordFunny", "keywordControversy", "keywordInteractive", "keywordEmotional", "keywordShopping", "asrKeyword", "topicChange", "speakerChange",
)
VISUAL = ("sceneChange", "motion", "faceCount")
SIGNALS = (*AUDIO, *TEXT, *VISUAL)
#: Event-like signals: padded with zeros, never stretched.
EVENTS = ("sceneChange", "asrKeyword", "speakerChange", "topicChange", "eventLaughter", "eventApplause", "eventMusic", "faceCount")
#: Signals whose own peaks anchor candidates.
ANCHORS = ("rms", "dmDensity", "dmAcceleration", "eventLaughter", "asrKeyword", "speakerChange")

CHAT = "recvTimeSec string, timestamp string, _time string, content string, text string, userId string, user_id string, type string, _corrupt_record string"
ASR = "room string, seg_idx int, start double, end double, text string, speaker string"
SIGNAL = "room long, t int, signal string, ord int, value double"


def room_type(rows: DataFrame) -> str:
    """The type of a table's rooms, for the schema of a grouped kernel."""
    return rows.schema["room"].dataType.simpleString()


def order_of(signal: Column) -> Column:
    """Place in the vocabulary; unknown names come last."""
    return F.coalesce(*[F.when(signal == s, F.lit(i)) for i, s in enumerate(SIGNALS)], F.lit(len(SIGNALS)))
