"""Physical-design helpers: size checks, skew-safe timelines, quantiles, ranks and folds."""
