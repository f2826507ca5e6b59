"""The benchmark's request texts (fixed values), with the kind of difficulty each poses."""

QUERIES = (
    ("q01", "structured", "Logistic companies in Romania"),
    ("q02", "structured", "Public software companies with more than 1,000 employees."),
    ("q03", "structured", "Food and beverage manufacturers in France"),
    ("q04", "reasoning", "Companies that could supply packaging materials for a direct-to-consumer cosmetics brand"),
    ("q05", "structured", "Construction companies in the United States with revenue over $50 million"),
    ("q06", "structured", "Pharmaceutical companies in Switzerland"),
    ("q07", "semantic", "B2B SaaS companies providing HR solutions in Europe"),
    ("q08", "semantic", "Clean energy startups founded after 2018 with fewer than 200 employees"),
    ("q09", "reasoning", "Fast-growing fintech companies competing with traditional banks in Europe."),
    ("q10", "reasoning", "E-commerce companies using Shopify or similar platforms"),
    ("q11", "semantic", "Renewable energy equipment manufacturers in Scandinavia"),
    ("q12", "reasoning", "Companies that manufacture or supply critical components for electric vehicle battery production"),
)
