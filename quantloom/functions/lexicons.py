"""Word lists and limits whose content decides results. Repeated entries count twice on purpose."""

# News words.
NEWS_POSITIVE = (
    "bullish surge rally gain growth beat strong upgrade buy outperform jump record soar profit earnings revenue success innovation leadership positive "
    "top leader advance up bull rising momentum confidence optimistic bullish exceeded outperform buy achieve break high increases improved better boost positive"
).split()
NEWS_NEGATIVE = (
    "bearish plunge crash fall decline miss weak downgrade sell underperform drop loss warning scandal lawsuit risk concern failed negative "
    "down bear falling bearish missed slump tumble pessimistic worst worse challenge difficult loss losses bad poor struggle cut reduced"
).split()
# News words of the first variant.
NEWS1_POSITIVE = ["surge", "jump", "gain", "profit", "growth", "strong", "beat", "upgrade", "bullish", "soar", "rally", "win", "success", "boom", "outperform", "analyst upgrade", "positive", "excellent"]
NEWS1_NEGATIVE = ["fall", "drop", "loss", "decline", "weak", "miss", "downgrade", "bearish", "crash", "plunge", "slump", "fail", "risk", "concern", "outflow", "analyst downgrade", "negative", "worst", "breach"]
# Phrases of earnings calls.
CALL_POSITIVE = ["beat", "exceed", "growth", "strength", "momentum", "guidance up", "raised", "outperform", "strong", "robust", "accelerated", "record", "expansion", "profitable"]
CALL_NEGATIVE = ["miss", "decline", "challenge", "headwind", "guidance down", "lowered", "underperform", "weakness", "pressure", "contraction", "concern", "risk", "difficult", "loss"]
GUIDANCE, RAISED, LOWERED = ["guidance", "outlook"], ["raise", "increased", "up", "higher"], ["lower", "decreased", "down"]
TOPICS = {
    "competition": ["competitor", "competitive", "rivalry", "differentiation"],
    "macro": ["economy", "gdp", "inflation", "rates", "macro", "market"],
    "product": ["product", "feature", "launch", "innovation", "roadmap"],
    "customer": ["customer", "churn", "retention", "acquisition", "nps"],
    "margin": ["margin", "gross margin", "operating margin", "profitability"],
}
# Allowed range of each metric.
METRIC_LIMITS = {
    "price": (0.01, 1e5), "volume": (0.0, 1e10), "eps": (-1000.0, 1e4), "pe_ratio": (0.0, 1000.0), "market_cap": (0.0, 1e14),
    "revenue": (0.0, 1e13), "inflation": (-5.0, 30.0), "unemployment": (0.0, 50.0), "fed_rate": (0.0, 20.0), "volatility": (0.0, 200.0),
}
# Filing deadlines (form, month, days after the period's end).
FILING_DEADLINES = [("10-K", 3, 60), ("10-K", 4, 60), ("10-Q", 5, 45), ("10-Q", 8, 45), ("10-Q", 11, 45)]
