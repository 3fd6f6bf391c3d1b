from breathline.plans import cohort, features, outcomes, study

__all__ = ["cohort", "features", "outcomes", "study"]
