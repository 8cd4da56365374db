"""Word lists, patterns, weights and messages that results depend on, stated as they must be."""

# --- Fixed values: guardrail patterns, in order -------------------------------------------------
INJECTION = [
    r"ignore (all|previous|above) instructions",
    r"you are now",
    r"system prompt",
    r"act as (a|an)\s",
    r"pretend (you|to be)",
    r"jailbreak",
    r"dan mode",
    r"\bsudo\b",
    r"reveal your (prompt|instructions|system)",
]

OFFTOPIC = [
    r"write (a |me )?(code|program|script|poem|essay|song|story)\b",
    r"\b(python|javascript|java|c\+\+|html|css|sql)\b.{0,60}\b(code|function|program|error|bug)\b",
    r"who (won|is the (prime minister|president|ceo))\b",
    r"\b(movie|film|cricket|football|match score|song lyrics|recipe)\b",
    r"\bmeaning of life\b",
    r"translate (this|the following)\b(?!.{0,40}(scheme|yojana|form|letter|document))"
    r".{0,60}\b(to|into)\s+(english|hindi|french|spanish|bengali|tamil|telugu|marathi)\b",
    r"what('?s| is) the weather\b",
    r"\bstock (price|market)\b",
    r"\b(cryptocurrency|bitcoin|ethereum)\b",
]

ABUSE = [
    r"\b(kill|suicide|bomb|weapon|hack|exploit)\b.{0,80}\b(make|build|create|how to)\b",
]

# --- Fixed values: replies and words that always pass the guardrail ------------------------------
SAFE_REPLIES = {
    "yes", "no", "ha", "haan", "हाँ", "नहीं", "nahi", "होय", "नाही",
    "ஆம்", "இல்லை", "হ্যাঁ", "না",
    "farmer", "labourer", "student", "woman hoh",
    "किसान", "मजदूर", "छात्र", "महिला",
    "🌾 farmer", "👷 labourer", "👩 woman hoh", "📚 student",
}

TOPIC_WORDS = {
    "scheme", "yojana", "eligib", "पात्र", "योजना", "document", "दस्तावेज़",
    "apply", "आवेदन", "benefit", "लाभ", "helpline", "wage", "मजदूरी",
    "pension", "पेंशन", "subsidy", "सब्सिडी", "card", "कार्ड", "income",
    "आय", "land", "ज़मीन", "bpl", "aadhaar", "आधार", "nrega", "mgnrega",
    "pmay", "pm kisan", "ration", "राशन",
}

# --- Fixed values: refusal messages by reason and language ---------------------------------------
REFUSALS = {
    "offtopic": {
        "en": "I'm a welfare scheme assistant, so I can't help with that. Ask me about government schemes, eligibility, documents, or how to apply — I'm happy to help with those!",
        "hi": "मैं एक कल्याण योजना सहायक हूँ, इसलिए इसमें मदद नहीं कर सकता। मुझसे सरकारी योजनाओं, पात्रता, दस्तावेज़ों या आवेदन के बारे में पूछें — मैं उसमें खुशी से मदद करूँगा।",
        "mr": "मी कल्याण योजना सहाय्यक आहे, त्यामुळे यात मदत करू शकत नाही. सरकारी योजना, पात्रता, कागदपत्रे किंवा अर्जाबद्दल विचारा.",
        "bn": "আমি একটি কল্যাণ প্রকল্প সহকারী, তাই এতে সাহায্য করতে পারি না। সরকারি প্রকল্প, যোগ্যতা, কাগজপত্র বা আবেদন সম্পর্কে জিজ্ঞাসা করুন।",
        "ta": "நான் ஒரு நலன் திட்ட உதவியாளர், எனவே இதில் உதவ முடியாது. அரசு திட்டங்கள், தகுதி, ஆவணங்கள் அல்லது விண்ணப்பிப்பது பற்றி கேளுங்கள்.",
    },
    "injection": {
        "en": "I can't follow instructions like that. I'm here only to help with government welfare scheme questions — feel free to ask about eligibility, documents, or benefits.",
        "hi": "मैं ऐसे निर्देशों का पालन नहीं कर सकता। मैं केवल सरकारी कल्याण योजना संबंधी सवालों में मदद के लिए हूँ — पात्रता, दस्तावेज़ या लाभ के बारे में पूछें।",
        "mr": "मी असे निर्देश पाळू शकत नाही. मी फक्त सरकारी कल्याण योजनेच्या प्रश्नांसाठी आहे.",
        "bn": "আমি এই ধরনের নির্দেশ অনুসরণ করতে পারি না। আমি শুধুমাত্র সরকারি কল্যাণ প্রকল্প সম্পর্কিত প্রশ্নে সাহায্য করি।",
        "ta": "நான் அத்தகைய வழிமுறைகளைப் பின்பற்ற முடியாது. நான் அரசு நலன் திட்டக் கேள்விகளுக்கு மட்டுமே உதவ முடியும்.",
    },
    "abuse": {
        "en": "I can't help with that request. If you have questions about welfare schemes, eligibility, or benefits, I'm here for that.",
        "hi": "मैं इस अनुरोध में मदद नहीं कर सकता। यदि आपके पास कल्याण योजनाओं के बारे में सवाल हैं, तो मैं यहाँ मदद के लिए हूँ।",
        "mr": "मी या विनंतीमध्ये मदत करू शकत नाही. कल्याण योजनांबद्दल प्रश्न असल्यास मी मदत करू शकतो.",
        "bn": "আমি এই অনুরোধে সাহায্য করতে পারি না। কল্যাণ প্রকল্প সম্পর্কে প্রশ্ন থাকলে আমি সাহায্য করতে পারি।",
        "ta": "இந்த கோரிக்கையில் எனக்கு உதவ முடியாது. நலன் திட்டங்கள் பற்றிய கேள்விகளுக்கு நான் இங்கே இருக்கிறேன்.",
    },
}

# --- Fixed values: languages ----------------------------------------------------------------------
MARATHI_WORDS = {
    "आहे", "नाही", "आणि", "मला", "तुम्ही", "करा", "होय", "नको",
    "सांगा", "माझा", "माझी", "शेतकरी", "मजूर", "मुलगी", "योजना",
    "कागदपत्रे", "अर्ज", "कुठे", "कसे", "काय", "जमीन", "माझे",
    "आम्ही", "तुमची", "असेल", "नसेल", "करायचे", "मिळेल", "पाहिजे",
}

LANGUAGE_NAMES = {
    "en": "English",
    "hi": "Hindi (हिंदी)",
    "mr": "Marathi (मराठी)",
    "bn": "Bengali (বাংলা)",
    "ta": "Tamil (தமிழ்)",
}

# --- Fixed values: seconds that cached responses live, by call type -------------------------------
TTL_SECONDS = {
    "slot_question":  7 * 24 * 3600,
    "scheme_answer":  24 * 3600,
    "scheme_answer_live": 6 * 3600,
    "general_answer": 24 * 3600,
    "classifier_opener": 24 * 3600,
}

# --- Fixed values: chunk type weights --------------------------------------------------------------
CHUNK_WEIGHTS = {
    "faq":          1.3,
    "eligibility":  1.2,
    "benefit":      1.15,
    "documents":    1.1,
    "apply":        1.1,
    "exclusion":    1.1,
    "state_wise":   1.05,
    "mistakes":     1.0,
    "overview":     1.0,
    "hindi":        1.0,
    "hindi_apply":  1.0,
    "hindi_docs":   1.0,
    "tamil":        0.95,
    "bengali":      0.95,
    "marathi":      0.95,
    "renewal":      0.9,
    "keywords":     0.85,
    "related":      0.8,
    "metadata":     0.75,
}

# --- Fixed values: yes and no words, occupation buttons -------------------------------------------
YES_WORDS = {
    "yes", "हाँ", "हां", "ha", "haan", "ஆம்", "হ্যাঁ", "होय",
    "✅ yes", "✅ हाँ", "✅ ஆம்", "✅ হ্যাঁ", "✅ होय",
    "ji", "haa", "bilkul",
}
NO_WORDS = {
    "no", "नहीं", "nahi", "nein", "இல்லை", "না", "नाही",
    "❌ no", "❌ नहीं", "❌ இல்லை", "❌ না", "❌ नाही",
    "nhi", "nope", "na",
}

OCCUPATION_BUTTONS = {
    "🌾 farmer": "farmer",       "🌾 किसान": "farmer",
    "🌾 விவசாயி": "farmer",     "🌾 কৃষক": "farmer",
    "🌾 शेतकरी": "farmer",
    "👷 labourer": "labourer",   "👷 मजदूर": "labourer",
    "👷 தொழிலாளர்": "labourer","👷 শ্রমিক": "labourer",
    "👷 मजूर": "labourer",
    "👩 woman hoh": "woman_hoh", "👩 महिला": "woman_hoh",
    "👩 பெண் தலைவி": "woman_hoh","👩 মহিলা": "woman_hoh",
    "👩 महिला प्रमुख": "woman_hoh",
    "📚 student": "student",     "📚 छात्र": "student",
    "📚 மாணவர்": "student",     "📚 ছাত্র": "student",
    "📚 विद्यार्थी": "student",
}

BINARY_SLOTS = {"has_land", "is_bpl", "has_girl_child", "is_pregnant"}


