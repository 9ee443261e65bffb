"""What a conversation turn asks about, and whether its claims hold."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

# Ordered keyword lists; the first list with a word inside the text wins (fixed values).
INTENTS = {
    "data": ["fraud rate", "pattern", "which", "highest", "email", "card", "device", "amount", "dataset", "what is", "explain"],
    "model": ["model", "auc", "accuracy", "shap", "xgboost", "smote", "calibrat", "feature"],
    "routing": ["route", "gateway", "razorpay", "payu", "stripe", "ccavenue", "routing", "upi", "netbanking"],
    "whatif": ["if", "what if", "threshold", "lower", "raise", "simulate"],
}
TOPICS = {
    "by_card_type": ["card type", "credit", "debit"],
    "by_network": ["network", "visa", "mastercard", "discover"],
    "by_device": ["device", "mobile", "desktop"],
    "by_email": ["email", "domain"],
    "by_amount": ["amount", "₹", "spend"],
    "gateway": ["gateway", "routing", "route", "upi", "netbank", "wallet"],
}
# A share of fraud stated in a text, and how far it may be off (fixed values).
CLAIM = r"(\d+\.?\d*)\s*%\s*(?:fraud)"
TOLERANCE = 1.5


def first_match(text: Column, lists: Mapping[str, Sequence[str]], otherwise: Column) -> Column:
    lowered = F.lower(text)
    found = otherwise
    for name, words in reversed(list(lists.items())):
        hit = F.lit(False)
        for word in words:
            hit |= F.contains(lowered, F.lit(word))
        found = F.when(hit, name).otherwise(found)
    return found


def intent(text: Column) -> Column:
    return first_match(text, INTENTS, F.lit("general"))


def topic(text: Column) -> Column:
    return first_match(text, TOPICS, F.lit(None).cast("string"))


def claims(text: Column) -> Column:
    """Every "x% fraud" of the text, as numbers."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(CLAIM), F.lit(1)), lambda x: x.cast("double"))


def corrections(text: Column, actual: Column) -> Column:
    wrong = F.filter(claims(text), lambda x: F.abs(x - actual) > TOLERANCE)
    return F.transform(wrong, lambda x: F.concat(
        F.lit("Fraud rate is "), actual.cast("string"), F.lit("%, not "), x.cast("string"), F.lit("%.")))
