from breathline.functions import clinical, numeric, text
from breathline.functions.numeric import half_even

__all__ = ["clinical", "half_even", "numeric", "text"]
