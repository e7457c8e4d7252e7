"""DataFrame to DataFrame operators: profile, explore, clean, features, models, plot data."""
