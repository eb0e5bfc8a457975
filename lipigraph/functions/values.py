"""Fixed values of the document dataflow: they must be these for its results to be right."""

from __future__ import annotations

# Words that tell a source language, and how much.
TOKEN_WEIGHTS = {
    "en": {
        "certificate": 3.0, "residence": 3.0, "request": 2.5, "please": 2.0, "submit": 2.5, "form": 1.0, "office": 1.5, "municipality": 3.0, "application": 2.5, "review": 2.0, "updates": 2.0, "applicant": 2.0,
        "reference": 2.0, "service": 2.5, "hours": 2.5, "residents": 2.5, "citizenship": 3.0, "original": 1.5, "photo": 2.0, "the": 1.0, "will": 1.0, "within": 1.5, "verify": 2.0, "visit": 1.0, "name": 1.0, "date": 1.0,
        "address": 2.0, "document": 2.5, "ward": 1.5, "fee": 1.5, "government": 3.0, "department": 2.5, "registration": 2.5, "approval": 2.5, "notice": 2.0, "authority": 2.5,
    },
    "ne": {
        "छ": 2.0, "हो": 1.5, "हुन्छ": 2.5, "थियो": 2.5, "छैन": 2.5, "गर्नुहोस्": 3.0, "गर्नेछ": 2.0, "भएको": 2.0, "लाई": 1.5, "मा": 1.0, "बाट": 2.0, "सँग": 2.0, "पनि": 1.5, "र": 0.5, "कृपया": 3.0, "बुझाउनुहोस्": 3.5,
        "नगरपालिकाले": 3.5, "आवेदन": 2.5, "दिनभित्र": 2.5, "हेर्नुहोस्": 3.0, "निवेदकको": 3.0, "मिति": 2.0, "बसोबास": 3.5, "प्रमाणपत्र": 3.0, "अनुरोध": 2.5, "कार्यालयमा": 2.0, "यो": 1.0, "त्यो": 1.0, "अपडेटका": 2.0,
        "सेवा": 2.0, "प्रदेश": 2.5, "सरकार": 2.5, "विवरण": 2.0, "अनुमति": 2.5, "निर्णय": 2.5,
    },
    "tmg": {
        "मुला": 3.0, "ङा": 2.5, "ङोसेबास्यो": 3.5, "ह्राङ": 2.5, "थुजेछे": 3.5, "हिम्बा": 3.0, "अहिम्बा": 3.0, "लासेला": 3.0, "लास्ह्युगो": 3.5, "गेदिमरि": 3.5, "न्हाङरि": 2.5, "स्ह्युसेनला": 3.5, "अद्यावधिकला": 3.0,
        "लागिरि": 2.5, "चु": 2.5, "पेस": 2.5, "निगो": 3.0, "स्ह्युसेन": 2.5, "पिन्बा": 2.5, "कुनु": 2.5, "लाबा": 2.5, "ह्रिबाला": 3.5, "प्रमाणस्यो": 3.5, "नगरपालिकासे": 3.5, "चिबा": 3.0, "दिम": 2.0, "ज्याबा": 2.5,
        "खरांबा": 2.0, "ल्होस्सो": 3.5, "फ्याफुल्ला": 3.5,
    },
}
# Words at home in several languages.
SHARED_TOKENS = ["वडा", "फोन", "शुल्क", "सन्दर्भ", "नं", "का", "को", "ले", "से", "npr", "id", "समीक्षा", "प्रमाणित", "ठेगाना", "फारम", "फाराम", "नगरपालिका"]
PHRASE_WEIGHT = 6.0
# The phrase bank, by key and language; the first five tell a language.
PHRASES = {
    "title": {"en": "Certificate of Residence Request", "ne": "बसोबास प्रमाणपत्र अनुरोध", "tmg": "चिबा ह्रिबाला प्रमाणस्यो"},
    "submit_form": {"en": "Please submit this form to the Ward Office.", "ne": "कृपया यो फारम वडा कार्यालयमा बुझाउनुहोस्।", "tmg": "चु फाराम वडा गेदिमरि पेस लास्ह्युगो।"},
    "review_within_days": {"en": "The Municipality will review the application within 7 days.", "ne": "नगरपालिकाले आवेदन ७ दिनभित्र समीक्षा गर्नेछ।", "tmg": "नगरपालिकासे ७ रे न्हाङरि स्ह्युसेनला समीक्षा लासेला मुला।"},
    "ward_verify": {"en": "Ward No. 4 will verify the address.", "ne": "वडा नं. ४ ले ठेगाना प्रमाणित गर्नेछ।", "tmg": "वडा नं. ४ से ठेगाना प्रमाणित लासेला मुला।"},
    "visit_updates": {"en": "Visit https://municipality.example.gov for updates.", "ne": "अपडेटका लागि https://municipality.example.gov हेर्नुहोस्।", "tmg": "अद्यावधिकला लागिरि https://municipality.example.gov निगो।"},
    "applicant_name": {"en": "Applicant Name", "ne": "निवेदकको नाम", "tmg": "स्ह्युसेन पिन्बा मिन"},
    "phone": {"en": "Phone", "ne": "फोन", "tmg": "फोन लाबा"},
    "date": {"en": "Date", "ne": "मिति", "tmg": "कुनु"},
    "reference_id": {"en": "Reference ID", "ne": "सन्दर्भ आईडी", "tmg": "सन्दर्भ ङोसेबास्यो"},
    "fee_500": {"en": "Fee: NPR 500", "ne": "शुल्क: NPR ५००", "tmg": "शुल्क: NPR ५००"},
}
TELLING_PHRASES = ["title", "submit_form", "review_within_days", "ward_verify", "visit_updates"]
# The terms of a new glossary (source and target language, domain, subdomain, terms, type).
DEFAULT_TERMS = [
    ("en", "ne", "public_service", None, "Ward Office", "वडा कार्यालय", "office"),
    ("en", "ne", "public_service", None, "Municipality", "नगरपालिका", "office"),
    ("en", "ne", "public_service", None, "Rural Municipality", "गाउँपालिका", "office"),
    ("en", "ne", "public_service", None, "District Administration Office", "जिल्ला प्रशासन कार्यालय", "office"),
    ("en", "ne", "public_service", None, "Public Service Commission", "लोक सेवा आयोग", "office"),
    ("en", "ne", "public_service", "residence", "Certificate of Residence", "बसोबास प्रमाणपत्र", "term"),
]
# Values that a deterministic provider writes in the target's digits, and references that keep theirs.
DATE_VALUE = r"^[0-9०-९]{4}[-/][0-9०-९]{2}[-/][0-9०-९]{2}$"
MONEY_VALUE = r"(?i)^(?:NPR|Rs\.?|रु\.?|\$)\s?[0-9०-९][0-9०-९,]*(?:\.[0-9]+)?$"
PHONE_VALUE = r"^\+?[0-9०-९][0-9०-९\-\s]{7,}$"
REFERENCE_VALUE = r"^[A-Z]{2,}(?:-[A-Z0-9]{2,})+$"
# Labels that a name follows.
NAME_LABELS = ["applicant name", "name", "निवेदकको नाम", "नाम", "स्ह्युसेन पिन्बा मिन"]
# Placeholders of a redacted text by kind.
PLACEHOLDERS = {"url": "<URL>", "email": "<EMAIL>", "phone": "<PHONE>", "id": "<ID>", "date": "<DATE>", "money": "<MONEY>", "number": "<NUMBER>", "ward": "<WARD>", "office": "<OFFICE>"}
REDACTION_MODE = "protected_entity_placeholders_v1"
PACK_NOTES = "Review-derived local export for feedback or corpus contribution. Privacy-reduced by default."
