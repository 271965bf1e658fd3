"""Vector and random-number functions."""
