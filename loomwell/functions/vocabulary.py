"""Word lists, dictionaries and texts that results have to agree on."""

from __future__ import annotations

# Fixed values. Query words that name nothing (Indonesian, English).
STOP_WORDS = ["apa", "adalah", "yang", "dan", "atau", "untuk", "dari", "ke", "di", "the", "is", "a", "an", "of", "to", "in"]

# Fixed values. Phrase, synonyms, related terms, terms in other languages; in order.
EXPANSIONS = [
    ("gigi berlubang", ["caries", "karies", "cavity"], ["tooth decay", "enamel damage"], ["dental caries", "tooth cavity"]),
    ("sakit gigi", ["toothache", "tooth pain"], ["pulpitis", "dental abscess"], ["dental pain", "odontalgia"]),
    ("karang gigi", ["calculus", "tartar"], ["plaque", "periodontal disease"], ["dental calculus", "tartar buildup"]),
    ("radang gusi", ["gingivitis", "gum inflammation"], ["periodontal disease", "gum disease"], ["gingivitis", "gum infection"]),
    ("sariawan", ["ulcer", "canker sore", "aphthous ulcer"], ["oral lesion", "mouth sore"], ["oral ulcer", "mouth ulcer"]),
]

# Fixed values. Name, ICD-10 code, SNOMED CT code.
ONTOLOGY = [
    ("caries", "K02", "80967001"),
    ("dental caries", "K02", "80967001"),
    ("gingivitis", "K05.0", "66383009"),
    ("periodontitis", "K05.3", "41565005"),
    ("pulpitis", "K04.0", "32620007"),
    ("tooth abscess", "K04.7", "399939004"),
    ("toothache", "K08.8", "27355003"),
    ("dental calculus", "K03.6", "109564008"),
    ("oral ulcer", "K12.0", "397156002"),
]

# Fixed values. Relations between two entities.
PREDICATES = ["causes", "treats", "prevents", "is_a", "located_in", "symptom_of"]

# Fixed values. Class names of detections in Indonesian.
CLASS_NAMES_ID = {
    "calculus": "karang gigi",
    "caries": "karies/gigi berlubang",
    "gingivitis": "radang gusi",
    "hypodontia": "gigi hilang",
    "tooth_discoloration": "perubahan warna gigi",
    "ulcer": "sariawan",
}

# Fixed values. Answer texts.
TEXTS = {
    "detections_id": "**Hasil Deteksi:**",
    "detections_en": "**Detection Results:**",
    "recommendations_id": "**Rekomendasi:**",
    "recommendations_en": "**Recommendations:**",
    "spatial": "**Spatial Analysis:**",
    "references_id": "\n\n---\n📚 **Sumber Referensi:**\n",
    "references_en": "\n\n---\n📚 **References:**\n",
    "high_id": "🟢 Tingkat kepercayaan tinggi (>80%)",
    "high_en": "🟢 High confidence (>80%)",
    "moderate_id": "🟡 Tingkat kepercayaan sedang (60-80%)",
    "moderate_en": "🟡 Moderate confidence (60-80%)",
    "low_id": "🔴 Tingkat kepercayaan rendah (<60%) - Konsultasi dokter gigi disarankan",
    "low_en": "🔴 Low confidence (<60%) - Professional consultation recommended",
    "low_answer": "⚠️ Low confidence in AI response. Please consult a dentist for accurate diagnosis.",
    "high_severity": "🚨 High pain severity detected. Seek immediate dental consultation.",
    "infection": "⚠️ Possible infection signs. Please see a dentist promptly.",
    "visit": "💡 For proper diagnosis and treatment, please visit a dentist.",
    "supported": "% of claims supported by sources (see citations below).",
    "risk_high": "⚠️ High hallucination risk detected. Verify claims with dentist.",
    "unsupported": " unsupported claims found. Use caution.",
    "low_accuracy": "🔴 Low confidence in response accuracy. Consult professional.",
    "no_claims": "No factual claims to validate",
    "validation_error": "Validation error",
    "no_entities": "No matching entities found in knowledge graph",
    "image_query": "(Image query)",
    "next_question": "Bisa ceritakan di mana lokasi sakit giginya?",
}

# Fixed values. Words that tell a symptom, in the order in which they are looked for.
CHARACTER_WORDS = [
    (["tajam", "sharp", "menusuk"], "sharp pain"),
    (["berdenyut", "throb", "pulsing"], "throbbing pain"),
    (["tumpul", "dull", "aching"], "dull ache"),
]
ASSOCIATION_WORDS = [(["bengkak", "swell"], "swelling"), (["berdarah", "bleed"], "bleeding"), (["demam", "fever"], "fever")]
SEVERITY_PATTERN = r"(\d+)/10|skala (\d+)|severity (\d+)"
INFECTION_WORDS = ["swelling", "bengkak", "fever", "demam"]

# Fixed values. Image quality: (measure, comparison, bound, issue, advice), in order.
IMAGE_ISSUES = [
    ("laplacian_var", "<", 100.0, "Severe blur detected", "Use tripod or increase lighting"),
    ("laplacian_var", "between", (100.0, 200.0), "Slight blur", "Hold phone steady"),
    ("mean_gray", "<", 50.0, "Image too dark", "Increase lighting or use flash"),
    ("mean_gray", ">", 200.0, "Image overexposed", "Reduce lighting"),
    ("std_gray", "<", 30.0, "Low contrast", "Better lighting on teeth"),
    ("color_balance_score", "<", 0.8, "Color imbalance detected", "Check white balance settings"),
    ("dental_focus_score", "<", 0.5, "Teeth not clearly visible", "Focus camera on oral cavity"),
]
