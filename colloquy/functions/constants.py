"""Fixed values. These must equal the published rules for results to agree."""

from __future__ import annotations

# Label domain.
LABELS = ("anger", "disgust", "fear", "joy", "neutral", "sadness", "surprise")

# Columns of a labelled corpus.
CORPUS_COLUMNS = ("user_input", "emotion_label", "bot_response")

# Risk levels.
NORMAL = "normal"
DISTRESS = "emotional_distress"
CRISIS = "potential_self_harm"
EMERGENCY = "emergency_high_risk"

# Risk patterns, most severe level first.
RISK_PATTERNS = (
    (EMERGENCY, (
        r"\b(i am|i'm|im) (going to|about to) (kill|end) myself\b",
        r"\b(i have|with) (a |the )?(gun|weapon|pills|rope)\b",
        r"\b(suicide plan|planned my suicide|goodbye everyone)\b",
    )),
    (CRISIS, (
        r"\b(kill myself|end my life|want to die|don't want to live|suicidal)\b",
        r"\b(hurt myself|self[- ]harm|cut myself)\b",
    )),
    (DISTRESS, (
        r"\b(overwhelmed|hopeless|worthless|can't cope|cannot cope|panic attack|numb|bad mood|feeling down)\b",
        r"\b(feel(?:ing)? (?:so )?(?:low|empty|alone|scared))\b",
    )),
)

# Replies that replace any other reply at an elevated risk level.
_URGENT_REPLY = (
    "I’m really sorry you’re dealing with this. I can’t provide emergency help, but your safety matters right now. "
    "Please contact local emergency services or a crisis line in your country now, and if you can, reach out to someone you trust to stay with you. "
    "If you are in the U.S. or Canada, call or text 988; elsewhere, use your local emergency number or find a local crisis service."
)
_DISTRESS_REPLY = (
    "That sounds really difficult. I’m here to listen, but I’m not a mental-health professional. "
    "If these feelings are becoming hard to manage, consider contacting a licensed professional or someone you trust."
)
SAFETY_REPLIES = {EMERGENCY: _URGENT_REPLY, CRISIS: _URGENT_REPLY, DISTRESS: _DISTRESS_REPLY}

# Intent words, tested in this order as substrings.
NEED_WORDS = ("food", "hungry", "eat", "eating", "meal", "drink", "water")
HELP_WORDS = ("help", "advice", "what should i do")
QUESTION_STARTS = ("how", "what", "why", "can you")
THANKS_WORDS = ("thank", "thanks")

# Reply templates of the message policy.
REPLIES = {
    "joy": (
        "I'm glad you shared that. What feels meaningful about this moment?",
        "That is good to hear. What has helped today feel a little lighter?",
    ),
    "sadness": (
        "That sounds heavy. You do not have to carry it alone right now. What has been weighing on you most?",
        "I'm sorry today feels like this. If it helps, we can take it one small piece at a time.",
    ),
    "anger": (
        "It makes sense that this feels frustrating. What happened?",
        "That sounds upsetting. Would you like to tell me what set this off?",
    ),
    "fear": (
        "That sounds unsettling. You are here in this moment; what feels most immediate right now?",
        "Feeling on edge can be exhausting. Would a slow breath and one small next step feel possible?",
    ),
    "surprise": (
        "That sounds unexpected. How are you making sense of it?",
        "That is a lot to take in at once. What part is staying with you?",
    ),
    "disgust": (
        "That sounds like a strong reaction to something unpleasant. I'm listening.",
        "It makes sense to be put off by that. Do you want to say more about what happened?",
    ),
    "neutral": (
        "Thanks for checking in. What would you like to talk through?",
        "I'm here with you. What has your day been like so far?",
    ),
}
LOW_CONFIDENCE_REPLIES = (
    "I'm not fully sure how to read that, but I hear that something may be off. What would feel most helpful right now: being heard, a small distraction, or thinking through a next step?",
    "Thank you for saying that. I may not have the emotion exactly right, so I don't want to assume. Can you tell me whether today feels more tiring, upsetting, or simply difficult?",
)
PRACTICAL_REPLIES = (
    "I wish I could bring you food. I can't do that directly, but if you can, a glass of water and something small to eat may help you feel a little steadier. Is there anyone nearby you could ask?",
    "I can't bring food, but I can stay with you while you decide on one easy option. Is there something simple nearby, or someone you could message for help?",
)

# Reply templates of the retrieval-or-classify route.
ROUTE_REPLIES = {
    "joy": (
        "That's wonderful to hear! What made today feel good?",
        "I'm glad you're feeling this way. Hold onto that.",
    ),
    "sadness": (
        "I hear you, and it's okay to feel this way. I'm here with you.",
        "That sounds heavy. Do you want to tell me more about it?",
    ),
    "anger": (
        "That sounds really frustrating. Your reaction makes sense.",
        "It's okay to feel angry about this. Want to talk through what happened?",
    ),
    "fear": (
        "That sounds unsettling. Let's slow down for a moment together.",
        "It's okay to feel uneasy. What's on your mind right now?",
    ),
    "surprise": (
        "That sounds unexpected! How are you processing it?",
        "Wow, that's a lot to take in suddenly. How do you feel about it?",
    ),
    "disgust": (
        "That sounds like a strong reaction to something unpleasant. I hear you.",
        "Understandable — that kind of thing can be hard to shake off.",
    ),
    "neutral": (
        "Thanks for sharing that. What's on your mind?",
        "I'm listening — feel free to tell me more.",
    ),
}
FALLBACK_REPLY = "I'm here and listening. Could you tell me a bit more about how you're feeling?"

# Phrases a generated reply may not contain.
BANNED_PHRASES = (
    "<think", "</think", "system prompt", "ignore previous instructions",
    "chain of thought", "internal reasoning", "as a therapist", "as a medical professional",
    "i diagnose", "you have a disorder", "you are diagnosed", "kill yourself",
)
REPLY_MIN_CHARS = 12
REPLY_MAX_CHARS = 900

# Response types of the message policy.
SAFETY_OVERRIDE = "safety_override"
PRACTICAL_SUPPORT = "practical_support"
GENERATED = "ollama_generated"
GENERATION_DISABLED = "llm_disabled"
GENERATION_UNAVAILABLE = "ollama_unavailable"
GENERATION_REJECTED = "ollama_validation_fallback"

# Response types of the retrieval-or-classify route.
VALIDATION_ERROR = "validation_error"
STORED_MATCH = "faq_match"
CLASSIFIED = "classifier_generated"
FALLBACK = "fallback"

# Validation messages.
EMPTY_MESSAGE = "message must be a non-empty string"
LONG_MESSAGE = "message must not exceed {limit} characters"
ROUTE_EMPTY_MESSAGE = "Message cannot be empty."
ROUTE_LONG_MESSAGE = "Message too long (max {limit} characters)."

# Confidence stances.
STANCE_CLARIFY = "Do not assume an emotion; ask a gentle clarifying question."
STANCE_CAUTIOUS = "Adapt cautiously."
STANCE_CLEAR = "Adapt clearly to the detected emotion."

# Numeric settings.
MAX_INPUT_CHARS = 500
LOW_CONFIDENCE = 0.45
CLARIFY_BELOW = 0.5
CAUTIOUS_BELOW = 0.8
MEMORY_TURNS = 6
RETENTION_DAYS = 30
DEFAULT_MATCH_THRESHOLD = 0.6
SPLIT_SEED = 42
EVAL_FRACTION = 0.2
VALIDATION_FRACTION = 0.15
FOLDS = 5
SHORT_WORDS = 3
LONG_QUANTILE = 0.95

# Status texts of the model comparison table.
STATUS_CV = "evaluated (5-fold CV on train.csv)"
STATUS_HELD_OUT = "evaluated (held-out set, single run)"
STATUS_PENDING = "PENDING — script provided, not executed"
