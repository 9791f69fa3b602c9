"""DataFrame operators: counts, information, violations, reliability, sampling, profiles, data generation."""
