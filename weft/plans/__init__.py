"""From the text of a rule to a DataFrame: lexer, parser, analyzer, translator, factorized rewrites."""
