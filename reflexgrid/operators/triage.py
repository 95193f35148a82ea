"""Rule-based triage: report and patient context to triggers, urgency and directives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import TriageSettings
from ..functions.numeric import pick

# Symptom table (id, label, category, description, red flag), in evaluation order.
SYMPTOMS = (
    ("LOSS_OF_CONSCIOUSNESS", "Loss of Consciousness (LOC)", "CRITICAL_RED_FLAG", "Witnessed or reported transient or prolonged unconsciousness following impact.", True),
    ("REPEATED_VOMITING", "Repeated Vomiting (≥ 2 episodes)", "CRITICAL_RED_FLAG", "Two or more vomiting episodes, indicating elevated intracranial pressure (ICP).", True),
    ("SEVERE_WORSENING_HEADACHE", "Progressively Worsening Headache", "CRITICAL_RED_FLAG", "Severe, escalating headache unresponsive to mild analgesics.", True),
    ("SEIZURE_CONVULSION", "Seizure or Post-Impact Convulsion", "CRITICAL_RED_FLAG", "Any tonic-clonic posturing, twitching, or witnessed seizure activity.", True),
    ("FOCAL_NEURO_DEFICIT", "Focal Neurological Deficit / Weakness", "CRITICAL_RED_FLAG", "Unilateral limb weakness, facial droop, numbness, or slurred speech.", True),
    ("NECK_PAIN_SPINAL_TENDERNESS", "Cervical Spine Pain / Midline Tenderness", "CRITICAL_RED_FLAG", "Pain along the cervical spine, tingling in extremities, or numbness.", True),
    ("CONFUSION_AMNESIA", "Disorientation / Post-Traumatic Amnesia", "MODERATE_NEURO", "Inability to recall events immediately before/after injury, repetitive questioning.", False),
    ("DIZZINESS_VERTIGO", "Dizziness or Balance Imbalance", "GENERAL_CONCUSSION", "Loss of balance, feeling lightheaded or unsteady on feet.", False),
    ("PHOTOPHOBIA_SENSITIVITY", "Photophobia / Light Sensitivity", "GENERAL_CONCUSSION", "Pain or discomfort in bright lighting, blurred vision.", False),
    ("UNEQUAL_PUPIL_SENSATION", "Visual Distortion / Unequal Pupil Blur", "MODERATE_NEURO", "Subjective report of asymmetric vision or blurry field in one eye.", False),
)
SYMPTOM_RATIONALE = "Associated with elevated intracranial pressure, acute structural lesion, or severe neurological trauma."
# Rationale text per rule.
RATIONALE = {
    "PLR_LOW_QUALITY": "Signal artifacts, excessive blinking, or head movement may invalidate automated latency and amplitude extraction.",
    "PLR_SEVERE_ANISOCORIA": "Marked anisocoria in the context of acute trauma indicates potential oculomotor nerve (CN III) compression or impending uncal herniation.",
    "PLR_MODERATE_ANISOCORIA": "May indicate mild autonomic asymmetry, early cranial nerve irritation, or physiological variation.",
    "PLR_BILATERAL_FIXED": "Severe bilateral midbrain or brainstem dysfunction, extensive bilateral oculomotor pathway compromise, or severe global cerebral ischemia.",
    "PLR_UNILATERAL_FIXED": "Classic sign of ipsilateral uncal herniation, third nerve palsy, or acute traumatic mydriasis.",
    "PLR_SLUGGISH_RESPONSE": "Reduced velocity and amplitude are sensitive markers of mild traumatic brain injury (mTBI), elevated intracranial pressure, or drug effects.",
    "PLR_DELAYED_LATENCY": "Afferent pupillary defect (optic nerve dysfunction) or efferent parasympathetic conduction delay.",
    "PLR_MARKED_ASYMMETRY": "Disproportionate kinetic response between eyes warrants closer neurological and ophthalmological investigation.",
}
# Directives.
SPINAL = "CRITICAL: Maintain rigid in-line cervical spine immobilization. Do NOT move the patient without spinal precautions."
DIRECTIVES = {
    "EMERGENCY_RED": (
        "1. Call Emergency Medical Services (EMS / 911) or initiate immediate transport to an emergency department with neurosurgical capabilities.",
        "2. Do NOT permit the patient to return to physical activity, sports, or driving.",
        "3. Keep patient calm, elevate head 30 degrees if no spinal trauma is suspected, and avoid sudden movements.",
        "4. Perform continuous Glasgow Coma Scale (GCS) and vital signs monitoring every 5 minutes.",
    ),
    "OBSERVE_AMBER": (
        "1. Remove athlete/patient from play or strenuous activity immediately (No Same-Day Return to Play).",
        "2. Conduct a comprehensive SCAT5 / neurological clinical exam.",
        "3. Re-screen pupil kinetics in 15–30 minutes to detect progressive deterioration or delayed onset anisocoria.",
        "4. Advise patient and caregivers on 24-hour red-flag signs (vomiting, worsening headache, confusion).",
    ),
    "INCONCLUSIVE_GRAY": (
        "1. Instruct patient to keep eyes wide open and look steadily at the screen crosshairs.",
        "2. Adjust ambient lighting to avoid direct glare and ensure face is evenly illuminated.",
        "3. Re-run the automated 5.2s screening protocol.",
    ),
    "NORMAL_GREEN": (
        "1. Bilateral pupillary kinetics within standard physiological baseline.",
        "2. Continue routine clinical monitoring if patient experienced a significant impact.",
        "3. Note: this is a screening decision-support aid, not a definitive diagnostic device. Clinical evaluation takes precedence.",
    ),
}
# Headlines and fixed summaries.
HEADLINES = {
    "EMERGENCY_RED": "🔴 ACUTE NEUROLOGICAL RED FLAG — IMMEDIATE MEDICAL ATTENTION",
    "OBSERVE_AMBER": "🟡 SLUGGISH / ASYMMETRIC DYNAMICS — CLINICAL OBSERVATION REQUIRED",
    "INCONCLUSIVE_GRAY": "⚪ INCONCLUSIVE SCREENING — RECALIBRATION & RETEST RECOMMENDED",
    "NORMAL_GREEN": "Normal Bilateral Pupillary Light Reflex",
}
GRAY_SUMMARY = (
    "Video tracking quality was suboptimal due to excessive head motion, blinking, or extreme lighting conditions. "
    "Numerical metrics may be incomplete."
)
GREEN_SUMMARY = (
    "Pupillary dynamics (constriction amplitude, velocity, latency, and symmetry) fall within normal physiological limits. "
    "No acute neurological red flags detected."
)


def symptom_dimension(spark: SparkSession) -> DataFrame:
    """The ten fixed symptoms as a table."""
    return spark.createDataFrame(SYMPTOMS, "symptom string, label string, category string, description string, is_red_flag boolean")


def symptom_rows(contexts: DataFrame) -> DataFrame:
    """One row per reported symptom with its definition (the dimension has ten fixed rows, so it is broadcast)."""
    dim = F.broadcast(symptom_dimension(contexts.sparkSession))
    return contexts.select("session_id", F.explode("symptoms").alias("symptom")).join(dim, "symptom")


def with_reports(contexts: DataFrame, reports: DataFrame) -> DataFrame:
    """Every context, with its report columns when a report exists."""
    return contexts.join(reports.withColumn("has_report", F.lit(True)), "session_id", "left").withColumn(
        "has_report", F.coalesce("has_report", F.lit(False))
    )


def _trigger(rule: str, when: Column, severity: str, title: Column, description: Column, category: str = "PUPILLOMETRY", rationale: str | None = None) -> Column:
    return F.when(
        when,
        F.struct(
            F.lit(rule).alias("id"), title.alias("title"), F.lit(category).alias("category"), F.lit(severity).alias("severity"),
            description.alias("description"), F.lit(rationale or RATIONALE[rule]).alias("rationale"),
        ),
    )


def triggers(rows: DataFrame, cfg: TriageSettings = TriageSettings()) -> DataFrame:
    """Add the ordered list of fired rules."""
    lq, rq = F.col("left_quality_score"), F.col("right_quality_score")
    lp, rp = F.col("left_constriction_pct"), F.col("right_constriction_pct")
    lv, rv = F.col("left_mcv_mm_s"), F.col("right_mcv_mm_s")
    ll, rl = F.col("left_latency_ms"), F.col("right_latency_ms")
    ani = F.col("baseline_anisocoria_mm")

    def fixed(side: str) -> Column:
        pattern = F.col(f"{side}_response_pattern")
        weak = F.col(f"{side}_constriction_pct") < cfg.fixed_pct
        if not cfg.count_unusable_as_fixed:
            weak = weak & (pattern != "INCONCLUSIVE")
        return (pattern == "NON_REACTIVE_FIXED") | weak

    def sluggish(side: str) -> Column:
        speed = F.col(f"{side}_mcv_mm_s")
        return (F.col(f"{side}_response_pattern") == "SLUGGISH_REDUCED") | ((speed < cfg.sluggish_mcv) & (speed > 0))

    left_fixed, right_fixed = fixed("left"), fixed("right")
    severe = ani >= cfg.severe_anisocoria_mm
    moderate = ~severe & (ani >= cfg.moderate_anisocoria_mm) & ~F.coalesce(F.col("known_anisocoria"), F.lit(False))
    fixed_side = F.when(left_fixed, F.lit("Left")).otherwise(F.lit("Right"))
    other_side = F.when(left_fixed, F.lit("Right")).otherwise(F.lit("Left"))
    fmt = F.format_string
    rules = [
        _trigger(f"SYM_{sid}", F.array_contains("symptoms", sid), "CRITICAL", F.lit(f"Red Flag Symptom: {label}"), F.lit(text), "SYMPTOM", SYMPTOM_RATIONALE)
        for sid, label, _, text, red in SYMPTOMS
        if red
    ]
    rules += [
        _trigger(
            "PLR_LOW_QUALITY", ~F.col("is_reliable") | (lq < cfg.min_quality) | (rq < cfg.min_quality), "WARNING",
            F.lit("Degraded Signal / Low Tracking Quality"),
            fmt("Tracking reliability score (L: %.0f%%, R: %.0f%%) is below acceptable clinical threshold.", lq, rq),
        ),
        _trigger(
            "PLR_SEVERE_ANISOCORIA", severe, "CRITICAL", fmt("Severe Baseline Anisocoria (Δ %.2f mm)", ani),
            fmt("Inter-eye baseline diameter difference of %.2f mm exceeds the 1.0 mm acute emergency threshold.", ani),
        ),
        _trigger(
            "PLR_MODERATE_ANISOCORIA", moderate, "WARNING", fmt("Physiological/Moderate Anisocoria (Δ %.2f mm)", ani),
            fmt("Baseline pupil asymmetry of %.2f mm is clinically noteworthy.", ani),
        ),
        _trigger(
            "PLR_BILATERAL_FIXED", left_fixed & right_fixed, "CRITICAL", F.lit("Bilateral Fixed / Non-Reactive Pupils"),
            fmt("Both left (%.1f%%) and right (%.1f%%) pupils demonstrate negligible constriction to light stimulus.", lp, rp),
        ),
        _trigger(
            "PLR_UNILATERAL_FIXED", (left_fixed | right_fixed) & ~(left_fixed & right_fixed), "CRITICAL",
            fmt("Unilateral Fixed Non-Reactive Pupil (%s Eye)", fixed_side),
            fmt("%s pupil is non-reactive (<5%% constriction) while %s eye retains reactivity.", fixed_side, other_side),
        ),
        _trigger(
            "PLR_SLUGGISH_RESPONSE", (sluggish("left") | sluggish("right")) & ~left_fixed & ~right_fixed, "WARNING",
            F.lit("Sluggish Pupillary Constriction Dynamics"),
            fmt("Constriction velocity (L: %.2f mm/s, R: %.2f mm/s) or amplitude is significantly reduced.", lv, rv),
        ),
        _trigger(
            "PLR_DELAYED_LATENCY", (ll > cfg.delayed_latency_ms) | (rl > cfg.delayed_latency_ms), "WARNING",
            fmt("Delayed Pupillary Latency (L: %.0f ms, R: %.0f ms)", ll, rl),
            F.lit("Reflex latency exceeds standard clinical threshold (normal range: 200–300 ms)."),
        ),
        _trigger(
            "PLR_MARKED_ASYMMETRY", F.col("asymmetry_severity") == "MARKED_ASYMMETRY", "WARNING", F.lit("Marked Dynamic Bilateral Asymmetry"),
            fmt("Latency difference is %.0f ms; MCV difference is %.2f mm/s.", F.col("latency_diff_ms"), F.col("mcv_diff_mm_s")),
        ),
    ]
    return rows.withColumn("triggers", F.array_compact(F.array(*rules)))


def assess(rows: DataFrame) -> DataFrame:
    """Urgency, texts and flags from the trigger list."""
    hits = lambda severity: F.size(F.filter("triggers", lambda x: x["severity"] == severity))
    rows = rows.withColumn("n_critical", hits("CRITICAL")).withColumn("n_warning", hits("WARNING"))
    low = F.exists("triggers", lambda x: x["id"] == "PLR_LOW_QUALITY")
    crit, warn = F.col("n_critical"), F.col("n_warning")
    urgency = pick(
        [(crit > 0, F.lit("EMERGENCY_RED")), ((warn > 0) & ~low, F.lit("OBSERVE_AMBER")), (low, F.lit("INCONCLUSIVE_GRAY"))],
        F.lit("NORMAL_GREEN"),
    )
    rows = rows.withColumn("urgency", urgency)
    level = F.col("urgency")
    by_level = lambda values, default: pick([(level == k, v) for k, v in values.items() if k != default], values[default])
    lines = by_level({k: F.array(*[F.lit(t) for t in v]) for k, v in DIRECTIVES.items()}, "NORMAL_GREEN")
    spinal = F.when(F.array_contains("symptoms", "NECK_PAIN_SPINAL_TENDERNESS"), F.array(F.lit(SPINAL))).otherwise(F.array().cast("array<string>"))
    plural = F.when(crit > 1, F.lit("s")).otherwise(F.lit(""))
    summaries = {
        "EMERGENCY_RED": F.format_string(
            "Urgent clinical alerts triggered (%d critical finding%s). High risk of acute traumatic brain injury or elevated intracranial pressure.", crit, plural
        ),
        "OBSERVE_AMBER": F.format_string(
            "Sluggish constriction velocity, latency prolongation, or moderate symptom markers observed (%d warning findings). Concussion / mTBI protocol recommended.", warn
        ),
        "INCONCLUSIVE_GRAY": F.lit(GRAY_SUMMARY),
        "NORMAL_GREEN": F.lit(GREEN_SUMMARY),
    }
    pupils = F.when(
        F.col("has_report"),
        F.struct(
            F.col("left_response_pattern").alias("left_pattern"), F.col("right_response_pattern").alias("right_pattern"),
            F.col("baseline_anisocoria_mm").alias("anisocoria_mm"), F.col("left_mcv_mm_s").alias("mcv_left"), F.col("right_mcv_mm_s").alias("mcv_right"),
            F.col("left_latency_ms").alias("latency_left_ms"), F.col("right_latency_ms").alias("latency_right_ms"),
        ),
    )
    return rows.select(
        "*", by_level({k: F.lit(v) for k, v in HEADLINES.items()}, "NORMAL_GREEN").alias("headline"),
        by_level(summaries, "NORMAL_GREEN").alias("summary"), F.concat(spinal, lines).alias("directives"),
        (level == "EMERGENCY_RED").alias("needs_transport"), level.isin("EMERGENCY_RED", "OBSERVE_AMBER").alias("needs_suspension"),
        pupils.alias("pupillometry"),
    )


def triage(contexts: DataFrame, reports: DataFrame, cfg: TriageSettings = TriageSettings()) -> DataFrame:
    return assess(triggers(with_reports(contexts, reports), cfg))


def trigger_rows(assessed: DataFrame) -> DataFrame:
    """One row per fired rule with its position."""
    return assessed.select("session_id", F.posexplode("triggers").alias("pos", "t")).select("session_id", "pos", "t.*")


def population_cube(assessed: DataFrame) -> DataFrame:
    """Counts for every combination of urgency, mechanism and time since injury, with all subtotals."""
    return assessed.cube("urgency", "mechanism", "time_elapsed").agg(
        F.grouping_id().cast("long").alias("level"), F.count(F.lit(1)).alias("patients")
    )
