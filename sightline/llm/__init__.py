"""Training-data operators over the texts, vectors and captures that an investigation gathers."""
