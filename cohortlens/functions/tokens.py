"""Fixed vocabularies.

These values must equal the behaviour being reproduced, so they are stated
plainly and kept together here.
"""

# --- fixed values: text that means "missing" (canonicalisation, cleaning) ---
MISSING_TOKENS = (
    "", "nan", "none", "null", "unknown", "unk", "not reported", "not known",
    "not specified", "not applicable", "n/a", "missing",
)

# --- fixed values: the smaller missing sets used by the odds/EDA code ---
EDA_MISSING_TOKENS = ("nan", "none", "")
EDA_UNKNOWN_TOKEN = "unknown"
WEIGHT_MISSING_TOKENS = ("unknown", "nan", "none")

# --- fixed values: boolean-like text (English / Spanish) ---
TRUE_TOKENS = ("1", "true", "yes", "si", "y", "positivo", "positive", "pos")
FALSE_TOKENS = ("0", "false", "no", "n", "neg", "negative")

# --- fixed values: "never diagnosed" answers ---
NEVER_TOKENS = ("2", "no", "never", "no (2)")

# --- fixed values: free-text smoking status keywords, in test order ---
SMOKING_POSITIVE_WORDS = ("current", "former", "ever", "smok")
SMOKING_NEGATIVE_WORDS = ("never", "no", "non")
SMOKING_TRUE_TEXT = ("true", "t", "yes", "y", "1")
SMOKING_FALSE_TEXT = ("false", "f", "0")

# --- fixed values: clinical columns that stay however many of their values are missing ---
PROTECTED_COLUMNS = (
    "age_years", "age_at_index", "height_last", "weight_last", "bmi_last", "tobacco_smoking_status_any",
    "pack_years_smoked_max", "sex", "gender", "race", "ethnicity", "domain",
)

# --- fixed values: outcome-leakage columns ---
LEAKAGE_COLUMNS = (
    "dem_vital_status", "dem_cause_of_death", "dem_days_to_death",
    "any_progression", "lost_to_followup", "last_days_to_follow_up",
)

# --- fixed values: id-like column names ---
ID_COLUMNS = ("submitter_id", "case_submitter_id", "case_key")

# --- fixed values: scoring labels ---
HIGH_RISK_LABEL = "Riesgo Alto"
LOW_RISK_LABEL = "Riesgo Bajo"

# --- fixed values: coded survey maps ---
CODED_SEX = {1: "male", 2: "female"}
CODED_HISPANIC = (1, 2)
CODED_RACE = {3: "white", 4: "black or african american", 6: "asian", 7: "other"}

# --- fixed values: canonical row ---
CANONICAL_NUMERIC = (
    "age_years", "height_last", "weight_last", "bmi_last",
    "tobacco_smoking_status_any", "pack_years_smoked_max",
)
CANONICAL_CATEGORICAL = ("sex", "ethnicity", "race")

# --- fixed values: sex normalisation for descriptive reports ---
SEX_MALE_TEXT = ("m", "male", "masculino", "man")
SEX_FEMALE_TEXT = ("f", "female", "femenino", "woman")

# --- fixed values: AJCC stage ordinal ---
AJCC_STAGES = (
    "stage 0", "stage i", "stage ia", "stage ib", "stage ic",
    "stage ii", "stage iia", "stage iib", "stage iic",
    "stage iii", "stage iiia", "stage iiib", "stage iiic",
    "stage iv", "stage iva", "stage ivb", "stage ivc",
)

# --- fixed values: Poisson(1) cumulative probabilities for k = 0..9 ---
POISSON1_CDF = (
    0.36787944117144233, 0.7357588823428847, 0.9196986029286058,
    0.9810118431238462, 0.9963401531726563, 0.9994058151824183,
    0.9999167588507119, 0.9999897508033253, 0.9999988747974020,
    0.9999998874797402,
)

# --- fixed values: age-pyramid bins (left-closed) and labels ---
PYRAMID_EDGES = (0, 20, 30, 40, 50, 60, 70, 80, 200)
PYRAMID_LABELS = (
    "Menos de 20", "Entre 20-29", "Entre 30-39", "Entre 40-49",
    "Entre 50-59", "Entre 60-69", "Entre 70-79", "80 y mas",
)

# --- fixed values: risk-statistics age bins (left-closed) ---
RISK_AGE_EDGES = (float("-inf"), 20, 30, 40, 50, 60, 70, 80, float("inf"))
RISK_AGE_LABELS = ("<20", "20-29", "30-39", "40-49", "50-59", "60-69", "70-79", "80+")

# --- fixed values: report grids (left-closed) ---
GRID_AGE_EDGES = (0, 40, 50, 60, 70, 80, float("inf"))
GRID_AGE_LABELS = ("<40", "40-49", "50-59", "60-69", "70-79", "80+")
GRID_BMI_EDGES = (0, 25, 30, float("inf"))
GRID_BMI_LABELS = ("Normal", "Sobrepeso", "Obeso")
CONCORDANCE_BMI_EDGES = (0, 18.5, 25, 30, 35, float("inf"))
CONCORDANCE_BMI_LABELS = ("<18.5", "18.5-24.9", "25-29.9", "30-34.9", "35+")
DECADE_EDGES = (20, 30, 40, 50, 60, 70, 80, 200)
DECADE_LABELS = ("20s", "30s", "40s", "50s", "60s", "70s", "80s+")

# --- fixed values: columns that make a clinical table worth keeping (triage) ---
TRIAGE_KEEP_COLUMNS = (
    "age_years", "age_at_index", "dem_age_at_index", "dem_days_to_birth", "mean_age_at_dx",
    "age_at_diagnosis", "sex", "gender", "dem_gender", "dem_sex_at_birth", "race", "dem_race",
    "ethnicity", "dem_ethnicity", "tobacco_smoking_status_any", "tobacco_smoking_status", "smq020",
    "smq040", "pack_years_smoked", "pack_years_smoked_max", "bmi", "bmi_last", "bmxbmi", "height",
    "height_last", "bmxht", "weight", "weight_last", "bmxwt",
)

# --- fixed values: flat case-table roll-ups ---
FAMILY_POSITIVE = ("1", "yes", "true", "si", "sí")
METASTASIS_POSITIVE = ("metastasis, nos", "yes")
YES_TOKENS = ("yes", "1")
TREATMENT_WORDS = {"any_chemo": "chemotherapy", "any_radiation": "radiation", "any_surgery": "surgery",
                   "any_immuno": "immunotherapy", "any_targeted": "targeted"}

# --- fixed values: features that make a regression target trivial ---
TARGET_RELATED = {
    "bmi_last": ("weight_last", "height_last"),
    "weight_last": ("bmi_last",),
    "mean_age_at_dx_years": ("age_years",),
}
