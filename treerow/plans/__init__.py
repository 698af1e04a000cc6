"""From statement text to a DataFrame: lexer, parser, checks, compiler."""
