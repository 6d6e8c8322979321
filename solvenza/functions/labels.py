"""Display labels of the coded columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from solvenza.schemas import LOWERED, RAISED

# Shown texts by code.
_RATING_CHANGE = {"상승": "등급 상승", "하락": "등급 하락"}
_DELINQUENCY = {"정상": "정상", "주의": "주의", "연체": "연체"}
_NOTIFICATION = {"down": "등급 하락", "warning": "하락 위험", "up": "등급 상승"}
_SENTIMENT = {"positive": "긍정", "negative": "부정", "neutral": "중립"}
_DIRECTION = {RAISED: "등급상승", LOWERED: "등급하락"}


def _mapped(code: Column, table: dict[str, str], otherwise: Column) -> Column:
    label = None
    for key, text in table.items():
        label = F.when(code == key, F.lit(text)) if label is None else label.when(code == key, F.lit(text))
    return label.otherwise(otherwise)


def rating_change_label(code: Column) -> Column:
    return _mapped(code, _RATING_CHANGE, F.lit("등급 유지"))


def delinquency_label(code: Column) -> Column:
    """Unknown codes are shown as they are."""
    return _mapped(code, _DELINQUENCY, code)


def notification_label(code: Column) -> Column:
    return _mapped(code, _NOTIFICATION, F.lit(None).cast("string"))


def sentiment_label(code: Column) -> Column:
    return _mapped(code, _SENTIMENT, F.lit(None).cast("string"))


def direction_label(code: Column) -> Column:
    return _mapped(code, _DIRECTION, F.lit("등급유지"))


def read_label(is_read: Column) -> Column:
    return F.when(is_read, F.lit("읽음")).otherwise(F.lit("읽지 않음"))


def change_arrow(delta: Column) -> Column:
    return F.when(delta > 0, F.lit("↑")).when(delta < 0, F.lit("↓")).otherwise(F.lit("→"))
