"""Result-verification operators, DataFrame in and DataFrame out."""
