"""Names, edges, labels and lists that results depend on, stated as they are."""

# --- fixed values: missing-value tokens and sentinels ---------------------------------
MISSING = "__MISSING__"
NULL_TEXT = "nan"
NULL_TEXT_NULLABLE = "<NA>"
NO_HOLIDAY_DAYS = 999
NEAR_HOLIDAY_DAYS = 3

# --- fixed values: white space removed at both ends of a text -------------------------
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# --- fixed values: bin edges and labels ([a, b) intervals) ----------------------------
INF = float("inf")
WAIT_DAYS_EDGES = [-INF, 7, 30, 90, 365, INF]
WAIT_DAYS_LABELS = ["0-7 days", "8-30 days", "31-90 days", "91-365 days", "365+ days"]
BMI_EDGES = [0, 18.5, 24.9, 29.9, 34.9, 39.9, INF]
BMI_LABELS = ["Underweight", "Normal", "Overweight", "Obese_I", "Obese_II", "Obese_III"]
DISTANCE_EDGES = [0, 5, 10, 20, 50, 100, 200, 500, INF]
BMI_RANGE = (10.0, 70.0)

# --- fixed values: calendar -----------------------------------------------------------
SEASON_OF_MONTH = {
    1: "Winter", 2: "Winter", 3: "Spring", 4: "Spring", 5: "Spring", 6: "Summer",
    7: "Summer", 8: "Summer", 9: "Fall", 10: "Fall", 11: "Fall", 12: "Winter",
}
DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
WEEKEND_DAYS = ["Friday", "Saturday"]

# --- fixed values: source column names -> names used here -----------------------------
COLUMN_NAMES = {
    "ת\"ז מותממת": "patient_id",
    "תאריך פתיחת בקשה": "request_date",
    "תאריך ביצוע ניתוח": "surgery_date",
    "מספר ניתוח תכנון": "plan_id",
    "חדר": "room",
    "הרדמה": "anesthesia",
    "קוד ניתוח": "procedure_code",
    "גיל המטופל בזמן הניתוח": "age",
    "BMI": "bmi",
    "תרופות קבועות": "medications",
    "אבחנות רקע": "diagnoses",
    "ALBUMIN": "albumin",
    "PT-INR": "pt_inr",
    "POTASSIUM": "potassium",
    "SODIUM": "sodium",
    "HB": "hb",
    "WBC": "wbc",
    "PLT": "plt",
    "עיר": "city",
    "אתר ניתוח": "surgery_site",
    "distance_km": "distance_km",
    "מין": "gender",
    "גורם משלם": "payer",
    "מצב משפחתי": "marital_status",
    "מחלקה מנתחת": "department",
}
LOG_COLUMN_NAMES = {
    "מספר ניתוח תכנון": "plan_id",
    "תאריך ביטול ניתוח": "cancel_date",
    "תאריך הניתוח המתוכנן בזמן הביטול": "planned_date_at_cancel",
}
SOURCE_ONLY_COLUMN_NAMES = {
    "מספר ניתוח ביצוע": "performed_plan_no",
    "ימים מתאריך פתיחת בקשה ועד תאריך ביצוע ניתוח": "wait_days_source",
}
CITY_COLUMN_NAMES = {"שם יישוב": "city", "ממוצע מדד חברתי-כלכלי 2017": "cluster"}

# --- fixed values: column groups ------------------------------------------------------
LAB_COLUMNS = ["albumin", "pt_inr", "potassium", "sodium", "hb", "wbc", "plt"]
FLAG_FEATURES = [
    "is_weekend", "bmi_missing", "has_missing_labs", "near_holiday",
    "is_surgery_after_holiday_weekend",
]
NUMERIC_FEATURES = [
    "age", "bmi", "albumin", "pt_inr", "potassium", "sodium", "hb", "wbc", "plt", "distance_km",
    "wait_days", "days_to_next_holiday", "days_from_prev_holiday",
    "num_existing_labs", "num_medications", "num_diagnoses",
    "site_room_cancel_rate_smoothed", "anesthesia_cancel_rate_smoothed",
    "procedure_code_cancel_rate_smoothed", "weekday_cancel_rate_smoothed",
    "distance_bucket_cancel_rate_smoothed",
    "is_weekend", "bmi_missing", "has_missing_labs", "near_holiday",
    "is_surgery_after_holiday_weekend",
]
CATEGORICAL_FEATURES = [
    "department", "surgery_site", "anesthesia", "gender", "payer", "marital_status",
    "surgery_weekday", "season", "age_decade", "wait_days_category", "bmi_category",
    "distance_bucket", "site_room",
]
NOT_FEATURES = [
    "patient_id", "plan_id", "request_date", "surgery_date", "performed_plan_no",
    "wait_days_source", "medications", "diagnoses", "procedure_code", "city", "room",
    "socioeconomic_cluster",
]
PREVIEW_COLUMNS = [
    "plan_id", "was_canceled", "site_room", "num_existing_labs", "socioeconomic_cluster",
    "wait_days_category", "bmi_category", "distance_bucket",
    "procedure_code_cancel_rate_smoothed",
]

# --- fixed values: threshold grid (start, step, number of points) ---------------------
GRID_START = 0.05
GRID_STEP = 0.010000000000000002
GRID_POINTS = 91
F1_EPSILON = 1e-9

# --- fixed values: split, folds, resampling and seeds ---------------------------------
SEED = 42
TEST_SHARE = 0.25
FOLDS = 3
MIN_CATEGORY_ROWS = 10
SMOTE_NEIGHBOURS = 5
INFREQUENT_SUFFIX = "_infrequent_sklearn"
