"""Thresholds, calendars and curves the forecasting rules are defined by."""

# Holiday type -> (default factor, closed likely).
HOLIDAY_TYPES = {
    "TET_DUONG_LICH": (1.10, False),
    "TET_NGUYEN_DAN": (0.10, True),
    "HUNG_KINGS": (1.15, False),
    "LIBERATION_DAY": (1.70, False),
    "LABOR_DAY": (1.70, False),
    "NATIONAL_DAY": (1.50, False),
    "PRE_HOLIDAY": (1.15, False),
    "POST_HOLIDAY": (0.90, False),
    "PRE_TET": (1.25, False),
    "POST_TET": (0.70, False),
}

# Words in a holiday name -> type, first match wins.
HOLIDAY_WORDS = [
    (["nguyên đán", "giao thừa", "mùng"], "TET_NGUYEN_DAN"),
    (["hùng vương"], "HUNG_KINGS"),
    (["chiến thắng", "giải phóng"], "LIBERATION_DAY"),
    (["lao động"], "LABOR_DAY"),
    (["quốc khánh"], "NATIONAL_DAY"),
]

# Month-day -> (event type, factor, days before, factor before).
SPECIAL_EVENTS = {
    "02-14": ("VALENTINE", 1.60, 1, 1.10),
    "03-08": ("WOMENS_DAY", 1.45, 1, 1.10),
    "10-20": ("VN_WOMENS_DAY", 1.50, 1, 1.10),
    "11-20": ("TEACHERS_DAY", 1.30, 1, 1.05),
    "12-24": ("CHRISTMAS", 1.50, 0, 1.0),
    "12-25": ("CHRISTMAS", 1.35, 0, 1.0),
    "10-31": ("HALLOWEEN", 1.20, 0, 1.0),
    "06-01": ("CHILDRENS_DAY", 1.25, 0, 1.0),
    "12-31": ("NEW_YEARS_EVE", 1.55, 0, 1.0),
    "03-14": ("WHITE_DAY", 1.15, 0, 1.0),
    "06-21": ("FATHERS_DAY", 1.15, 0, 1.0),
    "05-11": ("MOTHERS_DAY", 1.20, 0, 1.0),
}
MID_AUTUMN = ("MID_AUTUMN", 1.30)

# Event type -> code of the feature; days before an event carry its code, 0 is none.
EVENT_CODES = {
    "VALENTINE": 1, "PRE_VALENTINE": 1,
    "WOMENS_DAY": 2, "PRE_WOMENS_DAY": 2,
    "VN_WOMENS_DAY": 3, "PRE_VN_WOMENS_DAY": 3,
    "TEACHERS_DAY": 4, "PRE_TEACHERS_DAY": 4,
    "CHRISTMAS": 5,
    "HALLOWEEN": 6,
    "CHILDRENS_DAY": 7,
    "NEW_YEARS_EVE": 8,
    "WHITE_DAY": 9,
    "FATHERS_DAY": 10,
    "MOTHERS_DAY": 11,
    "MID_AUTUMN": 12,
}

# Profile thresholds.
MIN_GAP_DAYS = 7
MAX_GAP_RATIO = 0.5
MIN_ACTIVE_DAYS = 7
OUTLIER_IQR = 2.5
GROWTH_STEPS = [(10, "STRONG_GROWTH"), (3, "MILD_GROWTH"), (-3, "STABLE"), (-10, "MILD_DECLINE")]
NEW_DAYS = 7
YOUNG_DAYS = 45
VOLATILE_CV = 0.5
HIGH_VOLUME_AVG = 200
LOW_VOLUME_DAILY = 20
MEDIUM_VOLUME_DAILY = 80
LOW_VOLUME_AVG = 30

# Calibration windows (pre, post) and limits.
CAL_WINDOWS = {"TET_NGUYEN_DAN": (14, 10)}
CAL_WINDOW_DEFAULT = (5, 5)
CAL_MIN_DAYS = 3
CAL_MIN_GUESTS = 5
CAL_LOOKBACK = 400

# Strategy -> (ml weight, ai weight).
STRATEGY_WEIGHTS = {
    "AI_ONLY": (0.0, 1.0),
    "AI_PRIMARY_ML_SECONDARY": (0.3, 0.7),
    "ENSEMBLE_WEIGHTED": (0.5, 0.5),
    "ML_PRIMARY_AI_VALIDATE": (0.7, 0.3),
    "ENSEMBLE_EQUAL": (0.5, 0.5),
    "BASELINE_ONLY": (0.0, 0.0),
    "HIGH_VOLUME_ML": (0.85, 0.15),
}
ML_SHARES = (0.60, 0.20, 0.20)

# Holiday curves by volume segment, days to holiday -> factor.
HOLIDAY_CURVES = {
    "HIGH_VOLUME": {-3: 1.10, -2: 1.20, -1: 1.40, 0: 0.20, 1: 0.60, 2: 0.80, 3: 0.90},
    "MEDIUM_VOLUME": {-3: 1.08, -2: 1.15, -1: 1.30, 0: 0.15, 1: 0.55, 2: 0.75, 3: 0.88},
    "LOW_VOLUME": {-3: 1.05, -2: 1.10, -1: 1.20, 0: 0.10, 1: 0.50, 2: 0.70, 3: 0.85},
}

# Monitoring limits.
HIT_ABS = 15
DRIFT_PCT = 15
RETUNE_MAPE = 40
MIN_ALERT_SAMPLES = 30

# Curves around holidays, (last day of the step, its start, change per day).
PRE_TET_STEPS = [(3, 1.25, -0.05), (7, 0.85, 0.033), (None, 0.90, 0.01)]
POST_TET_STEPS = [(2, 0.50, 0.05), (5, 0.65, 0.075), (None, 0.85, 0.05)]

# Limits of the shift residual model (share of the forecast) and its damping.
RESIDUAL_LARGE = 100
RESIDUAL_LIMITS = {"weekday_evening": 0.30, "weekday_morning": 0.12, "weekend_evening": 0.25}
RESIDUAL_MORNING_DAMPING = 0.45
RESIDUAL_LEAST = 1.0

# Points of a run against the one before: (much better, better, much worse, worse).
VERDICT_STEPS = {"mae": (-0.5, -0.1, 1.0, 0.3), "wmape": (-3, -1, 5, 2), "hit_rate": (3, 1, -5, -2)}

# Grades 5 to 2 of a run by wmape at most and by hit rate at least, and their names.
GRADE_WMAPE = (15, 25, 35, 50)
GRADE_HIT_RATE = (75, 60, 45, 30)

# Learned segment factors, limits for large and other segments; confidence of a segment
# (least, most, at the start, gain of a step, gain of a confirmed one); bias from which on a direction counts.
SEGMENT_FACTOR_LARGE = (0.75, 1.45)
SEGMENT_FACTOR = (0.85, 1.25)
SEGMENT_CONFIDENCE = {"least": 0.30, "most": 0.95, "start": 0.45, "step": 0.03, "confirmed": 0.1}
DIRECTION_BIAS = 2

# Escalation of the correction factor (mape from which steps are large, large and small
# step, distance from 1 that counts, shares of the way back to 1 on target and otherwise).
ESCALATE_MAPE = 50
ESCALATE_STEPS = (0.02, 0.01)
ESCALATE_OFF = 0.01
ESCALATE_BACK = (0.10, 0.05)

# Stagnation rule (distance from 1 that counts, share of the way back, mape below this
# share of the older one is better, within this share is flat, push per level, runs it needs, top level).
STAGNATION = {"off": 0.005, "back": 0.05, "better": 0.97, "flat": 0.03, "push": 0.005, "runs": 10, "top": 2}
