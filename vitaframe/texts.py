"""Sentences, titles and advice shown to participants.

``{}`` marks where an operator puts a number or a name.
"""

FINDINGS = {
    "bp_high": "Your average blood pressure of {} mmHg indicates elevated levels that may need attention",
    "hr_high": "Your resting heart rate averages {} bpm, which is above the normal range (60-100 bpm)",
    "steps_low": "Your daily step count averages {} steps, below the recommended 10,000 steps",
    "sleep_low": "You're getting {} hours of sleep per night, below the recommended 7-9 hours",
    "spo2_low": "Your oxygen saturation averages {}%, which may indicate respiratory concerns",
    "strong_relationship": "Strong relationship found: your {} and {} are {} correlated (r={})",
    "unusual_days": "Detected {} unusual {} days ({}% of monitoring period)",
}

SUMMARY = {
    "bp": "Average blood pressure: {}/{} mmHg",
    "hr": "Average heart rate: {} bpm",
    "steps": "Average daily steps: {}",
    "sleep": "Average sleep: {} hours per night",
    "spo2": "Average oxygen saturation: {}%",
    "temp": "Average temperature: {}°F",
}

BEHAVIOUR = {
    "hr_morning_peak": "Your heart rate peaks in the morning around {}:00 ({} bpm)",
    "hr_evening_peak": "Your heart rate is highest in the evening around {}:00 ({} bpm)",
    "bp_morning_peak": "Your blood pressure tends to be highest in the morning around {}:00",
    "steps_weekdays": "You're most active on {}s ({} steps) and least active on {}s ({} steps)",
    "sleep_weekend": "You sleep longer on weekends ({} hours on {}s) vs weekdays ({} hours on {}s)",
}

RECOMMENDATIONS = {
    "bp_high": {
        "category": "Blood Pressure",
        "priority": "High",
        "text": "Consider discussing your elevated blood pressure with a healthcare provider",
        "actions": [
            "Reduce sodium intake to less than 2,300mg daily",
            "Increase physical activity to 150 minutes per week",
            "Monitor blood pressure regularly",
        ],
        "target": "Reduce average to below 120 mmHg",
    },
    "steps_low": {
        "category": "Physical Activity",
        "priority": "Medium",
        "text": "Increase daily activity from current {} steps",
        "actions": [
            "Set a goal of 500 additional steps per week",
            "Take stairs instead of elevators",
            "Park further away or get off transit one stop early",
            "Take 5-minute walking breaks every hour",
        ],
        "target": "Reach 10,000 steps daily",
    },
    "sleep_low": {
        "category": "Sleep Quality",
        "priority": "High",
        "text": "Increase sleep duration from current {} hours",
        "actions": [
            "Set a consistent bedtime 30 minutes earlier",
            "Create a relaxing bedtime routine",
            "Avoid screens 1 hour before bed",
            "Keep bedroom cool and dark",
        ],
        "target": "Achieve 7-9 hours of sleep nightly",
    },
    "steps_sleep": {
        "category": "Lifestyle Synergy",
        "priority": "Medium",
        "text": "Your activity and sleep are positively connected",
        "actions": [
            "Maintain consistent exercise routine for better sleep",
            "Aim for morning or afternoon workouts",
            "Track both metrics to optimize the relationship",
        ],
        "target": "Leverage exercise for improved sleep quality",
    },
    "recovery_low": {
        "category": "Health Monitoring",
        "priority": "Medium",
        "text": "Improve {} recovery patterns",
        "actions": [
            "Monitor {} more closely during unusual periods",
            "Identify triggers for abnormal readings",
            "Develop strategies for faster recovery",
        ],
        "target": "Achieve faster return to normal ranges",
    },
}

PROGRESS = {
    "strengthening": "Relationship between {} and {} is getting stronger over time",
    "weakening": "Relationship between {} and {} is weakening over time",
    "recent_anomalies": "{} recent {} anomalies",
}

EXPLANATIONS = {
    ("positive", "high"): "These metrics move together consistently. Improving one typically helps the other.",
    ("positive", "medium"): "These metrics often influence each other, though other factors play a role too.",
    ("negative", "high"): "These metrics balance each other - when one increases, the other naturally decreases.",
    ("negative", "medium"): "These metrics sometimes work in opposite directions, reflecting your body's balancing systems.",
}

BADGES = {
    "significant": "✓ Statistically Strong",
    "likely": "~ Likely Pattern",
    "emerging": "? Emerging Pattern",
}

CARD_TEXTS = {
    "clear": "There is a {} {} relationship between {} and {} (r={}, p={}). This relationship is {}.",
    "unclear": (
        "The analysis shows a {} {} trend between {} and {} (r={}), but this relationship is {} (p={}). "
        "This could be due to chance or insufficient data."
    ),
    "steps_sleep_positive": " This suggests that more physical activity might be associated with better sleep patterns.",
    "steps_sleep_negative": (
        " This suggests that higher activity levels might be associated with shorter sleep duration, "
        "possibly due to lifestyle factors."
    ),
    "steps_hr": (
        " This indicates that more physical activity is associated with elevated heart rate, as expected."
    ),
    "hr_temp": (
        " This relationship between heart rate and temperature could reflect physiological responses."
    ),
    "small": " Note: Small sample size limits reliability of results.",
    "moderate": " Moderate sample size provides reasonable confidence.",
    "good": " Good sample size supports reliable conclusions.",
}

COHORT = {
    "cohort_size": "Cohort includes {} participants with {} different health metrics.",
    "overall_quality": "Overall data quality: {}% of records passed quality checks.",
    "bp_high_share": "Blood pressure: {}% of readings show elevated systolic pressure (≥140 mmHg).",
    "hr_elevated": "Heart rate: Cohort average of {} bpm indicates elevated resting heart rate.",
    "hr_fit": "Heart rate: Cohort average of {} bpm suggests good cardiovascular fitness.",
    "steps_goal_share": "Physical activity: {}% of days meet the 10,000 steps guideline.",
    "sleep_short": "Sleep: Cohort averages {} hours per night, below recommended 7-9 hours.",
    "sleep_long": "Sleep: Cohort averages {} hours per night, above typical range.",
}

RELATIONS = {
    "same_day": "{} {} correlation",
    "no_same_day": "No significant relationship detected",
    "next_day": "Higher {} today {} {} {} tomorrow",
    "no_next_day": "No significant next-day effect of {} on {}",
}
