"""Language models, encoders and annotators behind functions that the caller gives."""
